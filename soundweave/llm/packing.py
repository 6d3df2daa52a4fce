"""Cost-balanced packing of tokenised documents into sequences of at most SEQUENCE tokens.

A document's ids are those of the given tokenizer file, then END. Whole sequences' worth of a long document become
sequences of their own; what is left of each document is packed within a group: a piece of n tokens costs
LINEAR * n + QUADRATIC * n * n (feed-forward and attention work). Descending pieces go to the sequence of the lowest
cost that has room for them (`Rooms` finds it exactly); if none has, the piece is cut at the remaining capacity of the
lowest-cost sequence. A group gets as few sequences as its tokens need, so all but one of them are full.

A group is up to GROUP_DOCS documents of one task, so packing needs no shuffle, its memory is bounded, and a task that
is run again gives the same rows. A sequence_id holds the task and the number within it.

tiktoken with the same vocabulary gives the same ids several times faster than tokenizers; it is used for texts of the
characters in PLAIN, where both split words alike, and tokenizers itself for any other text.

Defined cases: a null text is empty and has the one token END; each row, repeated ones too, has its own pieces; an
empty table gives no pieces; other columns are ignored. A long text is tokenised whole. Of pieces of one size the one
that came first goes first, and of sequences of one cost the one with the least number is taken.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, documents, groups, record, texts

SEQUENCE, END = 1024, 0
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
GROUP_DOCS = 50_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Basic Latin without the control characters on which libraries' white space differs, Latin letters, common signs.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ſ‐-‧‰-⁞]*")

NONE = (math.inf, -1)  # no sequence

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


@lru_cache(2)
def encoders(tokenizer: str, ranks: str | None):
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    if ranks is None:
        return exact, None, ()
    import public_tokenizers

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return exact, fast, tuple(t.content for t in exact.get_added_tokens_decoder().values())


def encode(text: str, tokenizer: str, ranks: str | None = None) -> np.ndarray:
    """The ids as uint32, with END."""
    exact, fast, special = encoders(tokenizer, ranks)
    if fast and PLAIN.fullmatch(text) and not any(s in text for s in special):
        ids = fast.encode_ordinary(text)
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END], "<u4")


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Rooms:
    """Sequences by their remaining capacity: those of one capacity lie in a heap by cost, and a tree over capacities has
    the least (cost, sequence) of each range of them."""

    def __init__(self, n: int, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.least = [NONE] * (2 * self.width)
        self.heaps[capacity] = [(0.0, i) for i in range(n)]
        self._lift(capacity)

    def _lift(self, room: int) -> None:
        at, least = room + self.width, self.least
        least[at] = self.heaps[room][0] if self.heaps[room] else NONE
        while at > 1:
            at >>= 1
            least[at] = min(least[2 * at], least[2 * at + 1])

    def add(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._lift(room)

    def take(self, size: int, room: list[int]) -> tuple[float, int]:
        """The sequence of the lowest cost with room for size, or NONE; it is taken out."""
        at, found = size + self.width, self.least[size + self.width]
        while at > 1:
            if not at & 1:  # the ranges of greater capacities
                found = min(found, self.least[at + 1])
            at >>= 1
        if found is not NONE:
            own = room[found[1]]
            heapq.heappop(self.heaps[own])
            self._lift(own)
        return found


def balance(sizes: list[int], capacity: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length); sizes are below or at the capacity."""
    n = -(-sum(sizes) // capacity)
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    room, rooms = [capacity] * n, Rooms(n, capacity)
    for size, item in sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
        start, left = 0, size
        while left:
            chosen = rooms.take(left, room)
            if chosen is NONE:
                chosen = rooms.take(1, room)
            total, i = chosen
            put = min(left, room[i])
            rows[i].append((item, start, put))
            start, left, room[i] = start + put, left - put, room[i] - put
            if room[i]:
                rooms.add(total + cost(put), i, room[i])
    return rows


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None) -> DataFrame:
    """One row per piece. ranks: the same vocabulary in tiktoken's form, if there is one."""
    arrow = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        made = 0
        done: list[tuple] = []  # pieces with a place
        rest: list[tuple] = []  # what is left of each document: doc_id, start, ids, doc_tokens

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal made, done, rest
            for pieces in balance([len(x[2]) for x in rest]):
                at = 0
                for item, start, length in pieces:
                    doc, first, ids, total = rest[item]
                    done.append((doc, first + start, length, zlib.crc32(ids[start : start + length].tobytes()), total, task + made, at, cost(length)))
                    at += length
                made += 1
            rest = []
            yield from flushed()

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal done
            if done:
                yield record(dict(zip([f.name for f in arrow], map(list, zip(*done, strict=True)), strict=True)), arrow)
            done = []

        for part in groups(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), texts(part), strict=True):
                ids = encode(text, tokenizer, ranks)
                whole = len(ids) - len(ids) % SEQUENCE
                for start in range(0, whole, SEQUENCE):
                    done.append((doc, start, SEQUENCE, zlib.crc32(ids[start : start + SEQUENCE].tobytes()), len(ids), task + made, 0, cost(SEQUENCE)))
                    made += 1
                if whole < len(ids):
                    rest.append((doc, whole, ids[whole:].copy(), len(ids)))
            yield from flushed()
            if len(rest) >= GROUP_DOCS:
                yield from settled()
        yield from settled()

    return documents(docs).mapInArrow(run, SCHEMA)
