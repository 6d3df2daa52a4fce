r"""Substring dedup of words: a count-min prefilter, then exact grouping.

A window is WINDOW consecutive words [^\x20\x09-\x0D]+ of one document. A word goes if it is covered by a window whose
words also start in a document with a smaller doc_id.

First pass: each chunk of documents (a partition of them) makes its count-min sketch of DEPTH rows, in sparse form:
its cells in order with counts 1 or 2 (which stands for more). Shards add the chunks' sketches, each for a range of
cells, and tell every chunk which of its cells hold 2 or more in all. A window all of whose DEPTH cells do is estimated
to be repeated; a merged sketch overestimates, so none that is repeated is lost. The width is four cells or more for
every word of the input and is split over shards in proportion, so no machine holds a whole sketch and the share of
false estimates (about 5 %) is the same at every size.

Second pass: only windows estimated to be repeated are grouped exactly, by 96 bits of two independent rolling hashes of
64-bit word hashes; a shard finds each window's least doc_id. Two of n different windows agree in all 96 bits with odds of
n * n / 2**97 (for 10**12 windows 1 in 150,000); no words are compared. Third pass: each chunk removes the words covered by
windows that have a smaller doc_id, in its own documents or elsewhere.

Defined cases: a null text has no words; fewer words than a window never repeat; a null doc_id is larger than all
others; rows of one doc_id are judged against smaller ids only, so repeated rows stay alike; an empty table gives an
empty result; other columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import FAN, MESSAGE, Least, bits, bounds, chunked, compressed, exchanged, expanded, flags, key_messages, mix, order_ids, prefix_hash, told_bits, total, unpack, window_hash, with_answers
from .common import arrow_schema, map_groups

WINDOW = 50
DEPTH = 2
SHARD_CELLS = 1 << 21  # entries a shard gets, about
BASE, BASE_CHECK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Hashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Chunk:
    """The windows of a chunk: sizes of its documents in words, hashes of its windows and their places."""

    def __init__(self, payload: bytes, keep_words: bool = False):
        self.ids, raws = unpack(payload)
        hashes, look = [], _Hashes()
        self.words, self.sizes = [], []
        for raw in raws:
            words = raw.split()
            self.sizes.append(len(words))
            hashes.append(np.fromiter(map(look.__getitem__, words), np.uint64, len(words)))
            if keep_words:
                self.words.append(words)
        del raws
        values = mix(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        sizes = np.array(self.sizes, np.int64)
        ends = np.cumsum(sizes)
        n = np.maximum(sizes - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(sizes)), n)
        self.starts = np.repeat(ends - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.key = window_hash(prefix_hash(values, BASE), self.starts, WINDOW, BASE)
        self.values = values

    def check(self, picked: np.ndarray) -> np.ndarray:
        return (window_hash(prefix_hash(self.values, BASE_CHECK), self.starts[picked], WINDOW, BASE_CHECK) >> np.uint64(32)).astype(np.uint32)


def cells(key: np.ndarray, row: int, width: int) -> np.ndarray:
    """A row's cell, below 2**width, of each key."""
    return mix(key + np.uint64(0x632BE59BD9B4E019) * np.uint64(row + 1)) >> np.uint64(64 - width)


def sketch(key: np.ndarray, row: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells in order, whether each holds 2 or more, the place among them of each key)."""
    found, place, counts = np.unique(cells(key, row, width), return_inverse=True, return_counts=True)
    return found, counts > 1, place


def sketch_message(cells: np.ndarray, many: np.ndarray) -> bytes:
    packed = compressed(np.diff(cells, prepend=cells[0]).astype(np.uint64))
    return np.array([len(packed), cells[0]], np.int64).tobytes() + packed + bits(many)


class Cells:
    """The exchange of a sketch's rows: cells in order and whether each holds 2 or more. Sketches are merged by adding them
    up, and the answer is which cells hold 2 or more in all."""

    def __init__(self, width: int):
        self.width = width

    def read(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        size, first = np.frombuffer(blob[:16], np.int64).tolist()
        found = np.cumsum(expanded(blob[16 : 16 + size], np.uint64), dtype=np.uint64) + np.uint64(first)
        return found, flags(blob[16 + size :], len(found))

    def merge(self, tables: list) -> tuple[tuple, list[np.ndarray]]:
        every, many = (np.concatenate([t[i] for t in tables]) for i in range(2))
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        place = np.empty(len(every), np.int64)
        place[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        hot = np.diff(np.append(start, len(ranked))) > 1
        if len(start):
            hot |= np.bitwise_or.reduceat(many[order], start)
        return (ranked[new], hot), np.split(place, np.cumsum([len(t[0]) for t in tables])[:-1])

    def messages(self, table: tuple, row: int, shards: int) -> Iterator[tuple[int, bytes]]:
        owners, cuts = bounds(table[0], shards, self.width)
        for s, a, b in zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield row * shards + s, sketch_message(table[0][a:b], table[1][a:b])

    def judge(self, blobs: list[bytes]) -> list[bytes]:
        (_, hot), places = self.merge([self.read(b) for b in blobs])
        return [bits(hot[p]) for p in places]

    def told(self, table: tuple, row: int, shards: int, own: dict[int, bytes]) -> np.ndarray:
        return told_bits(table[0], row, shards, self.width, own)

    def passed(self, table: tuple, merged: tuple, place: np.ndarray, told: np.ndarray) -> bytes:
        return bits((told | merged[1])[place])


def estimated(chunk: Chunk, own: dict[tuple[int, int], bytes], width: int, shards: int) -> np.ndarray:
    """The windows whose estimate is 2 or more."""
    out = np.ones(len(chunk.key), bool)
    for row in range(DEPTH):
        found, _, place = sketch(chunk.key, row, width)
        out &= told_bits(found, row, shards, width, {s: b for (k, s), b in own.items() if k == row})[place]
    return np.flatnonzero(out)


def local(chunk: Chunk, picked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, checks, least doc_ids) of the distinct picked windows in order, and each picked window's place."""
    key, check, ids = chunk.key[picked], chunk.check(picked), order_ids(chunk.ids)[chunk.doc[picked]]
    order = np.lexsort((ids, check, key))
    k, c = key[order], check[order]
    new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])) if len(k) else np.zeros(0, bool)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], c[new], ids[order][new], place


def removed(chunk: Chunk, own: dict[tuple[int, int], bytes], width: int, shards: int) -> np.ndarray:
    """The windows that a smaller doc_id has too."""
    picked = estimated(chunk, own, width, shards)
    keys, _, least, place = local(chunk, picked)
    smaller = told_bits(keys, 0, shards, 64, {s: b for (k, s), b in own.items() if k == DEPTH})
    return picked[smaller[place] | (least[place] < order_ids(chunk.ids)[chunk.doc[picked]])]


def covered(starts: np.ndarray, n: int, size: int = WINDOW) -> np.ndarray:
    """Which of n places are in a window that starts at one of starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, fan: int = FAN, cells_a_shard: int = SHARD_CELLS) -> DataFrame:
    """SCHEMA, and kept string: the words that stay, joined by one space."""
    spark = docs.sparkSession
    chunks = chunked(docs)
    n_chunks, size = total(chunks)
    words = max(1, size // 4)  # more than prose has; an error here changes sizes, never results
    width = max(16, (4 * words - 1).bit_length())
    shards = min(max(1, -(-words // cells_a_shard)), fan * fan)
    ranges, work = min(shards, fan), Cells(width)

    def send_sketch(batch) -> dict:
        out = {"shard": [], "chunk": [], "blob": []}
        for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            chunk = Chunk(payload)
            for row in range(DEPTH):
                for s, blob in work.messages(sketch(chunk.key, row, width)[:2], row, ranges):
                    out["shard"].append(s)
                    out["chunk"].append(number)
                    out["blob"].append(blob)
        return out

    sent = map_groups(chunks.select("chunk", "payload"), send_sketch, MESSAGE, "payload", 1)
    # A sketch row is a kind of answer of its own.
    estimates = exchanged(sent, work, 0, shards, n_chunks, fan).withColumn("kind", F.floor(F.col("shard") / ranges).cast("int"))
    estimates = estimates.select("chunk", "kind", "shard", "blob")

    def send_keys(number: int, payload: bytes, own: dict) -> dict:
        chunk = Chunk(payload)
        keys, check, least, _ = local(chunk, estimated(chunk, own, width, ranges))
        made = list(key_messages(keys, check, least, ranges))
        return {"shard": [s for s, _ in made], "chunk": [number] * len(made), "blob": [b for _, b in made]}

    exact = exchanged(with_answers(chunks, estimates, send_keys, MESSAGE, arrow_schema(spark, MESSAGE)), Least(), DEPTH, shards, n_chunks, fan)

    def finish(number: int, payload: bytes, own: dict) -> dict:
        chunk = Chunk(payload, keep_words=True)
        gone = covered(chunk.starts[removed(chunk, own, width, ranges)], sum(chunk.sizes))
        out = {"doc_id": chunk.ids, "n_words": chunk.sizes, "n_removed": [], "kept_sha256": [], "kept": []}
        at = 0
        for words in chunk.words:
            own_gone = gone[at : at + len(words)]
            at += len(words)
            n = int(own_gone.sum())
            kept = b" ".join([w for w, g in zip(words, own_gone.tolist(), strict=True) if not g] if n else words)
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode())
        return out

    schema = SCHEMA + ", kept string"
    return with_answers(chunks, estimates.unionByName(exact), finish, schema, arrow_schema(spark, schema))


