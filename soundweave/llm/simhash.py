r"""SimHash near-dedup by bit-sliced comparison.

Fingerprints: A-Z lower-cased, words [^\x20\x09-\x0D]+, 3-word shingles with repeats, each hashed by XXH64 with seed
42; a bit is set if over half of the hashes have it. Equal fingerprints are one class, so copies cost nothing further.

Links: with BLOCKS = 8 blocks of 8 bits, fingerprints that differ in at most RADIUS = 2 bits agree in some six blocks.
Each distinct fingerprint goes to the 28 buckets named by six of its blocks. A bucket holds at most 2**16 distinct
fingerprints, since only two blocks are free; a third of all rows in one group of copies can't make it larger. Within a
bucket, fingerprints are kept as bit planes: plane j holds bit j of 64 fingerprints a word. A query's differences with
blocks of 64 are counted plane by plane with carry-save counters (ones, twos, over), over the planes in which the bucket's
fingerprints differ at all; once all of a block's bits in `over` are set, the block is abandoned. Buckets of SMALL
fingerprints or fewer are compared together, each with the one s places on, for each s. Of a bucket's links only a spanning
forest is returned, with a row less than it has fingerprints at most, never all pairs.

Components: alternating large and small stars over the links between classes, staged after each round, until nothing
changes.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; repeated rows each give a row;
null doc_ids are never a component's name unless it has no other; an empty table gives an empty result; other columns
are ignored. A bit that exactly half of the hashes have is not set. A text of any length is read whole; its shingles are
counted in steps. Of rows with one doc_id and text `one_of_each` keeps one, no matter which.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, files, lookup, map_groups, raw_texts, stage

SEED, RADIUS, BLOCKS = 42, 2, 8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MASKS = [sum(0xFF << 8 * i for i in range(BLOCKS) if i not in out) for out in combinations(range(BLOCKS), RADIUS)]


def fingerprint(raw: bytes, size: int = 3) -> int:
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray, step: int = 1 << 14) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def planes(values: np.ndarray) -> np.ndarray:
    """(64, words) uint64: word w of plane j holds bit j of values 64w .. 64w + 63; the last word is filled with zeros."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(differences: Iterator[np.ndarray], words: int) -> np.ndarray | None:
    """Bits of the positions with at most two differences, from planes of differences; None if the block was abandoned."""
    ones, twos, over = (np.zeros(words, np.uint64) for _ in range(3))
    full = ~np.uint64(0)
    for j, d in enumerate(differences):
        carry = ones & d
        ones ^= d
        over |= twos & carry | twos & ones  # three or more
        twos |= carry
        if j % 8 == 7 and (over == full).all():
            return None
    return ~over


def blocks_within(block: np.ndarray, value: int, which: list[int], first: int) -> tuple[np.ndarray, np.ndarray]:
    """(words from first on, bits of the positions in them that differ from value in at most two of the planes which)."""
    live = np.arange(first, block.shape[1])
    ones, twos, over = (np.zeros(len(live), np.uint64) for _ in range(3))
    full = ~np.uint64(0)
    for i, j in enumerate(which, 1):
        d = block[j, live] ^ (full if value >> j & 1 else np.uint64(0))
        carry = ones & d
        over |= twos & (carry | (ones ^ d))  # three or more
        ones ^= d
        twos |= carry
        if i % 4 == 0 and (done := over == full).any():
            live, ones, twos, over = (x[~done] for x in (live, ones, twos, over))
            if not len(live):
                break
    return live, ~over


def forest(values: np.ndarray) -> np.ndarray:
    """For each of the distinct values of one bucket, the least value linked with it within the bucket."""
    n = len(values)
    label = np.arange(n)
    block, differ = planes(values), int(np.bitwise_or.reduce(values) ^ np.bitwise_and.reduce(values))
    which = [j for j in range(64) if differ >> j & 1]
    for q in range(n - 1):
        words, near = blocks_within(block, int(values[q]), which, (q + 1) // 64)  # earlier ones have been queries themselves
        if not near.any():
            continue
        bits = np.unpackbits(near.view(np.uint8), bitorder="little").reshape(len(words), 64)
        found = (words[:, None] * 64 + np.arange(64))[bits.astype(bool)]
        found = found[(found > q) & (found < n)]
        if len(found):
            merge = np.unique(np.append(label[found], label[q]))
            if len(merge) > 1:
                label[np.isin(label, merge)] = merge[0]
    return values[label]


def small_forests(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of many small buckets at once: (values, the least value linked with each, if another). The pairs s
    apart of all buckets form one bit-sliced comparison for each s; labels then sink along the links."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = ends - starts
    for s in range(1, int(sizes.max(initial=1))):
        wide = sizes > s
        at = np.concatenate([np.arange(a, b - s) for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True)])
        a, b = planes(values[at]), planes(values[at + s])
        near = within((a[j] ^ b[j] for j in range(64)), a.shape[1])
        if near is not None:
            hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
            hit = hit[hit < len(at)]
            left.append(at[hit])
            right.append(at[hit] + s)
    a, b, label = np.concatenate(left), np.concatenate(right), np.arange(len(values))
    while len(high := np.flatnonzero(label[a] != label[b])):
        low = np.minimum(label[a[high]], label[b[high]])
        np.minimum.at(label, a[high], low)
        np.minimum.at(label, b[high], low)
    off = np.flatnonzero(label != np.arange(len(values)))
    return values[off], values[label[off]]


SMALL = 24


def bucket_links(tables: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links of whole buckets; rows are in order of table and key."""
    new = np.flatnonzero(np.append(True, (tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])))
    ends = np.append(new[1:], len(values))
    several = ends - new > 1
    starts, ends = new[several], ends[several]
    small = ends - starts <= SMALL
    left, right = [], []
    if small.any():
        a, b = small_forests(values, starts[small], ends[small])
        left.append(a)
        right.append(b)
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        own = values[s:e]
        root = forest(own)
        off = own != root
        left.append(own[off])
        right.append(root[off])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: tuple[np.ndarray, ...] | None = None

    def out(t: np.ndarray, k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(t, k, v.view(np.uint64))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(now[0]):
            continue
        t, k, v = now if rest is None else tuple(map(np.concatenate, zip(rest, now, strict=True)))
        last = (t == t[-1]) & (k == k[-1])  # its bucket may go on
        cut = len(t) - int(last.sum())
        rest = (t[cut:], k[cut:], v[cut:])
        if cut:
            yield out(t[:cut], k[:cut], v[:cut])
    if rest is not None:
        yield out(*rest)


def links(classes: DataFrame) -> DataFrame:
    """(a, b) from distinct fingerprints (column fp): in every component of the links, a path of such rows."""
    keys = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in MASKS])).alias("t", "k"))
    dealt = keys.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    return dealt.mapInArrow(_links, "a long, b long").where("a <> b")


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges, which are about rows; root is the least node reachable.

    Each round turns edges into stars around local minima (large stars, then small stars); the number of rounds grows
    with the logarithm of the longest path. Only counts come to the driver."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows=rows)
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()
        before = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stage(large, rows=2 * seen[0])
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a")
        now = stage(small.select("a", F.col("low").alias("b")).unionByName(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct(), rows=2 * seen[0])


def _fingerprints(batch: pa.RecordBatch) -> dict:
    values = np.array([fingerprint(raw) for raw in raw_texts(batch)], np.uint64)
    return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(values.view(np.int64))}


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash (of the text, to tell rows of one doc_id apart), fp (signed), root (the
    component's least fingerprint) and component_id."""
    prints = stage(map_groups(documents(docs).withColumn("text_hash", F.xxhash64("text")), _fingerprints, "doc_id long, text_hash long, fp long"))
    rows = prints.count()
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), rows=rows)
    rows_of_classes = classes.count()
    stars = components(links(classes), rows_of_classes)
    rooted = stage(classes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root")), rows=rows_of_classes)
    names = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("m")), rows=rows_of_classes)
    named = stage(lookup(rooted.select("fp", "n", "root"), names, "root", "m"), rows=rows_of_classes)
    return files(lookup(prints, named, "fp", "n"), rows)


def fingerprint_rows(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the document with the least doc_id (nulls last), once."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    # One key for the join and for the ranking, so that the texts move once.
    key = lambda doc, text_hash: {"_d": F.coalesce(doc, F.lit(0)), "_h": text_hash, "_z": doc.isNull()}
    stays = first.select(*[c.alias(n) for n, c in key(F.col("k.doc_id"), F.col("k.text_hash")).items()])
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc, text = (F.col(f"_{names.index(n)}") for n in ("doc_id", "text"))
    keyed = plain.withColumns(key(doc.cast("long"), F.xxhash64(text.cast("string"))))
    kept = keyed.join(stays, ["_d", "_h", "_z"], "left_semi")
    once = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_h", "_z").orderBy(F.lit(0))))
    return once.where("_n = 1").drop("_d", "_h", "_z", "_n").toDF(*names)
