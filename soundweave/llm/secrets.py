r"""Secret scans with corpus-wide ownership frequency.

Each whole text is scanned once. Base findings are leftmost and non-overlapping per kind (assign, access, hex; see
BASE). Besides them, long mixed tokens are candidates. Each candidate is known by a hash of its value, and the hashes
are aggregated over the corpus: in how many distinct repositories and by how many distinct owners a value occurs. A
value of WIDELY owners or more is an example that was copied; a value of fewer owners that looks live (entropy, no
placeholder) is a credential, in however many repositories. Tokens judged so become findings of kind `owned`; base
findings stay whatever the verdict and are counted by it: n_shared has those of WIDELY owners or more, n_live the
live-looking rest, owned tokens among them.

An owner is `source`; a repository is one language's part of a source (`source`/`lang`). Spans are those of the whole
match, in code points, end exclusive.

Scale: texts don't move. Findings (a few bytes each) are staged once; hashes are aggregated with map-side combining, so
that a value found in a third of all rows arrives as one row a task. Verdicts of values in over 1/HOT_PARTS of all
findings (HOT_PARTS rows at most) are broadcast, others are joined by hash, so no join key is hot.

Defined cases: a null text is empty and has no finding; a null source or lang is an owner or part of its own;
repeated rows each give a row and count once per owner; an empty table gives an empty result; other columns are
ignored. Of equal texts, each is scanned. Findings that start at one place come in the order of their kinds. A text of any
length is scanned and masked whole, in time that follows its length and its findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, lookup, map_groups, stage, texts

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "owned")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|your|placeholder|x{4}|0{6}|12345|abcdef", re.IGNORECASE)
LEAST_BITS = 3.0  # of entropy per character in a live-looking value
WIDELY = 3
HOT_PARTS = 256

FOUND = "array<struct<kind: int, first: int, until: int, value: binary, live: boolean>>"
SCAN_SCHEMA = f"doc_id long, text_hash long, owner string, part string, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    return entropy(value) >= LEAST_BITS and not PLACEHOLDER.search(value)


def base_findings(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, first, until, value), by kind and then place."""
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def extra_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with lower-case and upper-case letters and digits that look live and touch no base finding."""
    out, starts, reach = [], [], []  # base findings by start, and how far those up to each reach
    for a, b in sorted((a, b) for _, a, b, _ in base):
        starts.append(a)
        reach.append(max(b, reach[-1] if reach else 0))
    for m in TOKEN.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v):
            before = bisect_left(starts, m.end())
            if (not before or reach[before - 1] <= m.start()) and looks_live(v):
                out.append((3, m.start(), m.end(), v))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], x[0], x[2])))


def _scan(batch: pa.RecordBatch) -> dict:
    out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
    for text in texts(batch):
        base = base_findings(text)
        n = Counter(k for k, *_ in base)
        for i, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(n[i])
        out["base_sha256"].append(hashlib.sha256(joined([x[:3] for x in base]).encode()).hexdigest())
        out["found"].append([{"kind": k, "first": a, "until": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "live": k == 3 or looks_live(v)} for k, a, b, v in base + extra_candidates(text, base)])
    return out | {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "owner": batch.column("source").cast(pa.string()), "part": batch.column("lang").cast(pa.string())}


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repositories, n_owners, n_found from rows (value, owner, part)."""
    null = "\0"
    repos = found.groupBy("value", F.coalesce("owner", F.lit(null)).alias("owner"), F.coalesce("part", F.lit(null)).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("value").agg(F.sum("repos").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_found"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: counts, base digest, and `verdicts`, an array of (kind, first, until, n_repositories, n_owners, live)
    with the base findings and the tokens judged to be an owner's credential."""
    rows = stage(map_groups(documents(docs, "source", "lang").withColumn("text_hash", F.xxhash64("text")), _scan, SCAN_SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", "owner", "part", F.explode("found").alias("f")).select("row", "owner", "part", "f.*")
    freq = stage(ownership(found))
    judged = lookup(found.drop("owner", "part"), freq, "value", "n_found", HOT_PARTS, "inner")
    judged = judged.select("row", F.struct("kind", "first", "until", "n_repositories", "n_owners", "live").alias("v"))
    kept = judged.where((F.col("v.kind") < 3) | (F.col("v.n_owners") < WIDELY)).groupBy("row").agg(F.collect_list("v").alias("verdicts"))
    return rows.drop("found").join(kept, "row", "left").withColumn("verdicts", F.coalesce("verdicts", F.array().cast("array<struct<kind:int,first:int,until:int,n_repositories:bigint,n_owners:bigint,live:boolean>>"))).drop("row")


def digests(scanned: DataFrame) -> DataFrame:
    """The result in flat columns."""
    ordered = F.sort_array(F.transform("verdicts", lambda v: F.struct(v["first"].alias("a"), v["kind"].alias("k"), v["until"].alias("b"))))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", kinds[x["k"]], x["a"].cast("string"), x["b"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("verdicts", test)).cast("long")
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"),
        count(lambda v: v["kind"] == 3).alias("n_owned"),
        count(lambda v: (v["kind"] < 3) & (v["n_owners"] >= WIDELY)).alias("n_shared"),
        count(lambda v: (v["n_owners"] < WIDELY) & v["live"]).alias("n_live"),
    )


MASK = "[SECRET]"


def masked(text: str, places: list[int]) -> str:
    """The text with each span (first, until, first, until, ...), or union of spans that touch or overlap, replaced by
    MASK; in one pass."""
    out, at = [], 0
    for i, (a, b) in enumerate(sorted(zip(places[::2], places[1::2], strict=True))):
        if a > at or not i:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked_text(text: F.Column, spans: F.Column) -> F.Column:
    """Null where there are no spans, and then no text leaves the JVM."""

    @F.pandas_udf("string")
    def kernel(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else masked(t, list(p)) for t, p in zip(texts, places, strict=True)], dtype=object)

    return kernel(F.when(spans.isNotNull(), text), F.flatten(F.transform(spans, lambda x: F.array(x["first"], x["until"]))))


def mask_secrets(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """docs with all their columns; findings in the texts are masked, and n_chars follows. Rows of one doc_id and text
    have the same findings, as a verdict depends on values alone."""
    spans = scanned.where(F.size("verdicts") > 0).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.transform("verdicts", lambda v: F.struct(v["first"].alias("first"), v["until"].alias("until"))).alias("_s"))
    one = spans.groupBy("_d", "_h").agg(F.first("_s").alias("_s"))
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = names.index("text")
    text, doc = F.col(f"_{at}"), F.col(f"_{names.index('doc_id')}")
    key = lambda d: F.coalesce(d, F.lit(0))
    right = one.select(key(F.col("_d")).alias("_k"), F.col("_d").isNull().alias("_z"), "_h", "_s")
    left = plain.withColumns({"_k": key(doc.cast("long")), "_z": doc.cast("long").isNull(), "_h": F.xxhash64(text.cast("string"))})
    out = left.join(right, ["_k", "_z", "_h"], "left").withColumn(f"_{at}", F.when(F.col("_s").isNull(), text).otherwise(masked_text(text.cast("string"), F.col("_s"))))
    if "n_chars" in names:
        i = names.index("n_chars")
        out = out.withColumn(f"_{i}", F.when(F.col("_s").isNull(), F.col(f"_{i}")).otherwise(F.length(f"_{at}").cast(docs.dtypes[i][1])))
    return out.drop("_k", "_z", "_h", "_s").toDF(*names)
