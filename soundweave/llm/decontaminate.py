"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

A word is a run of letters, digits or bytes beyond ASCII, with A-Z lower-cased. Each word of the benchmark is a number of
three digits to the base 85, with other characters for each place, so that a text becomes a line of such numbers (NONE for
words that the benchmark hasn't), which the automaton scans once. A match begins and ends at words; its place in the line
is its place in words, and `original_offsets` gives its bytes in the original.

A window is WINDOW consecutive words of an item, or the whole item if it has fewer. The automaton's keys are the items
of fewer words, and of the others the HALF words from every HALF-th word on: each window holds one of these whole, at one
of its first HALF places. So a match names at most HALF windows around it, and these are looked up as they are in a table
of all windows. The automaton has three nodes a word of the benchmark at most, none with over 85 followers.

The benchmark is the stated query set. It is read in passes of at most PASS_WORDS words, so that what is sent to a worker
(and built there once, for all its tasks) is bounded however many items there are; a usual benchmark is one pass, and
then no row moves. Further passes scan the texts again, and a document's hits are put together by its row.

Defined cases: a null text has no words; an item without words has no window; equal items all count, and so do items that
share a window; repeated documents each give a row; items with a null item_id mark words but aren't listed; an empty
table on either side gives no hits or no rows; other columns are ignored. A text of any length is scanned whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, columns, documents, filter_rows, groups, raw_texts, record, stage

WINDOW, HALF = 10, 5
PASS_WORDS = 1 << 19
BASE, DIGITS = 85, 3
NONE = "\0" * DIGITS

#: A-Z to a-z; what is no word byte to a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


class Scanner:
    """The automaton of some items (item_id, words joined by spaces), and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.numbers: dict[bytes, str] = {}
        self.owners: dict[str, tuple | set] = {}  # most windows have one item, whose tuple they share
        self.automaton = ahocorasick.Automaton()
        for item, text in items:
            words = [self.numbers.setdefault(w, number(len(self.numbers))) for w in text.split()]
            short, one = len(words) < WINDOW, (item,)
            for i in range(max(1, len(words) - WINDOW + 1)):
                window = "".join(words[i : i + WINDOW])
                own = self.owners.setdefault(window, one)
                if isinstance(own, set):
                    own.add(item)
                elif own != one:
                    self.owners[window] = {*own, item}
            for i in [0] if short else range(0, len(words) - HALF + 1, HALF):
                key = words if short else words[i : i + HALF]
                self.automaton.add_word("".join(key), len(key))
        if items:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(spans of hit words as [begin, end) word indexes in order, items). The words are read once."""
        spans, items = [], set()
        if words and self.owners:
            get = self.numbers.get
            line = "".join([get(w, NONE) for w in words])
            for last, n in self.automaton.iter(line):
                until = (last + 1) // DIGITS
                first = until - n
                if (own := self.owners.get(line[first * DIGITS : until * DIGITS])) is not None:  # a whole item
                    spans.append((first, until))
                    items.update(own)
                if n == HALF:
                    for i in range(max(0, first - HALF + 1), min(first, len(words) - WINDOW) + 1):
                        if (own := self.owners.get(line[i * DIGITS : (i + WINDOW) * DIGITS])) is not None:
                            spans.append((i, i + WINDOW))
                            items.update(own)
        return merged(spans), items


def number(i: int) -> str:
    """The digits of i, each place with characters of its own."""
    return chr(1 + i // BASE**2) + chr(1 + BASE + i // BASE % BASE) + chr(1 + 2 * BASE + i % BASE)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_offsets(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The byte spans in the original text of spans of words."""
    inside = np.frombuffer(b" " + raw.translate(TABLE) + b" ", np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # a word's start and end in turn
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]


def passes(benchmark: DataFrame, most: int = PASS_WORDS) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in passes of bounded size, read by partition; only one pass is at the driver at a time."""
    held, size = [], 0
    for row in columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = words_of((row["text"] or "").encode())
        if not words:
            continue
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append((row["item_id"], b" ".join(words)))
        size += len(words)
    yield held


_scanners: dict[str, Scanner] = {}


def _sent(spark: SparkSession, benchmark: DataFrame, most: int) -> list[tuple[str, object]]:
    """The passes, broadcast, by name."""
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast(items)) for items in passes(benchmark, most)]


def _scanner(sent: tuple[str, object]) -> Scanner:
    """The scanner of the broadcast items, built once a worker."""
    name, value = sent
    if name not in _scanners:
        if len(_scanners) > 1:
            _scanners.clear()
        _scanners[name] = Scanner(value.value)
    return _scanners[name]


SPANS = "array<struct<first: int, until: int, begin: long, end: long>>"


def _hits(docs: DataFrame, sent: tuple[str, object]) -> DataFrame:
    """doc_id, row, n_words, spans and items of each row (doc_id, text, row) against one pass."""
    schema = f"doc_id long, row long, n_words long, spans {SPANS}, items array<string>"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent)
        for part in groups(batches):
            out = {"doc_id": part.column("doc_id"), "row": part.column("row"), "n_words": [], "spans": [], "items": []}
            for raw in raw_texts(part):
                words = words_of(raw)
                spans, found = scanner.scan(words)
                places = original_offsets(raw, spans) if spans else []
                out["n_words"].append(len(words))
                out["spans"].append([{"first": a, "until": b, "begin": x, "end": y} for (a, b), (x, y) in zip(spans, places, strict=True)])
                out["items"].append(list(found))
            yield record(out, arrow)

    return docs.mapInArrow(run, schema)


def _joined(found: DataFrame) -> DataFrame:
    """One row for each row of all passes; spans that overlap or touch become one."""
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]  # an entry a pass
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column("spans").to_pylist():
                place = {x["first"]: x["begin"] for x in spans} | {-x["until"]: x["end"] for x in spans}
                out.append([{"first": a, "until": b, "begin": place[a], "end": place[-b]} for a, b in merged([(x["first"], x["until"]) for x in spans])])
            at = batch.schema.get_field_index("spans")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return whole.mapInArrow(run, whole.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = PASS_WORDS) -> DataFrame:
    """SCHEMA, with spans: hit words as [first, until) indexes and as [begin, end) bytes of the original text."""
    plain, sent = documents(docs), _sent(docs.sparkSession, benchmark, most)
    if len(sent) == 1:
        found = _hits(plain.withColumn("row", F.lit(0).cast("long")), sent[0])
    else:
        numbered = stage(plain.withColumn("row", F.monotonically_increasing_id()))
        found = _joined(reduce(DataFrame.unionByName, [_hits(numbered, s) for s in sent]))
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["until"] - x["first"]))
    told = found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items"), "spans")
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"), "spans")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, most: int = PASS_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, without any hit word; no shuffle."""
    names = docs.columns
    left = docs.toDF(*[n if n == "text" else f"_{i}" for i, n in enumerate(names)])  # names that clash can't be staged
    for i, sent in enumerate(_sent(docs.sparkSession, benchmark, most)):
        left = filter_rows(stage(left) if i else left, lambda raws, sent=sent: [not _scanner(sent).scan(words_of(raw))[0] for raw in raws])
    return left.toDF(*names)
