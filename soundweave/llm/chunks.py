"""Chunks of whole documents, and exact exchanges of sorted keys between them.

A chunk is a row with about CHUNK_BYTES of text, compressed; it is staged, so that each later pass sees the same
chunks. In an exchange every chunk sends its distinct keys in sorted order to shards by range, one message a shard;
a shard answers each message with a bit for every key in its order. Keys are distinct within a chunk, so a key that a
third of all documents hold reaches its shard once a chunk; the number of shards grows with the input, so a shard's
size doesn't.

A chunk sends FAN messages at most. Where there are more shards than that, it sends to FAN ranges, and of each range the
messages of about FAN chunks are merged (equal keys become one) before they go on to the shards, FAN messages at most for
each merger again; answers come back the same way. So the number of messages is 2 * FAN a chunk at most, in proportion to
the input at any size, and a key that every chunk holds reaches its shard once a merger, not once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, groups, stage, tasks

CHUNK_BYTES = 4 << 20
FAN = 1024
NULL_ID = np.int64(2**63 - 1)  # a null doc_id is larger than any other

MESSAGE = "shard long, chunk long, blob binary"
ANSWER = "chunk long, kind int, shard long, blob binary"


_compressors: dict[int, zstandard.ZstdCompressor] = {}  # one of each level for all messages of a worker


def compress(data: bytes, level: int = 1) -> bytes:
    if level not in _compressors:
        _compressors[level] = zstandard.ZstdCompressor(level)
    return _compressors[level].compress(data)


def expand(data: bytes) -> bytes:
    if -1 not in _compressors:
        _compressors[-1] = zstandard.ZstdDecompressor()
    return _compressors[-1].decompress(data)


def compressed(array: np.ndarray) -> bytes:
    """Integers with the bytes of like weight together, which packs small values well."""
    array = np.ascontiguousarray(array)
    return compress(array.view(np.uint8).reshape(-1, array.itemsize).T.tobytes())


def expanded(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(expand(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def chunked(docs: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """chunk long, size long (bytes), n long (rows), payload binary; staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, made
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            row = pa.record_batch([pa.array([task + made]), pa.array([size]), pa.array([table.num_rows]), pa.array([compress(sink.getvalue().to_pybytes(), 3)], pa.binary())], names=["chunk", "size", "n", "payload"])
            held, size, made = [], 0, made + 1
            return row

        for part in groups(batches, budget=limit // 4):
            now = pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
            if held and size + now > limit:
                yield out()
            held.append(pa.record_batch([part.column("doc_id"), part.column("text").cast(pa.string())], names=["doc_id", "text"]))
            size += now
        if held:
            yield out()

    return stage(documents(docs).mapInArrow(run, "chunk long, size long, n long, payload binary"), "none")


def unpack(payload: bytes) -> tuple[list[int | None], list[bytes]]:
    with pa.ipc.open_stream(pa.py_buffer(expand(payload))) as reader:
        table = reader.read_all()
    return table.column("doc_id").to_pylist(), [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]


def order_ids(ids: list[int | None]) -> np.ndarray:
    return np.array([NULL_ID if i is None else i for i in ids], np.int64)


def bounds(keys: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shards that have some of the sorted keys below 2**bits, cuts of the keys between them)."""
    shard = shard_of(keys, shards, bits)
    new = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else np.zeros(0, np.int64)
    return shard[new].astype(np.int64), np.append(new, len(keys))


def shard_of(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Equal ranges of the keys; only their top 32 bits are used, so that nothing overflows."""
    top = keys >> np.uint64(max(0, bits - 32))
    return (top * np.uint64(shards)) >> np.uint64(min(32, bits))


def answers(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]], kind: int, size: int | None = None) -> DataFrame:
    """answer gets all messages of a shard and returns a blob for each; ANSWER rows, staged. size: the bytes of text that
    the messages come from, which then limit the number of files."""

    def run(table: pa.Table) -> pa.Table:
        shards, chunks = table.column("shard").to_pylist(), table.column("chunk")
        out = answer(table.column("blob").to_pylist())
        return pa.table([chunks.cast(pa.int64()), pa.array([kind] * len(out), pa.int32()), pa.array(shards, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "kind", "shard", "blob"])

    found = messages.groupBy("shard").applyInArrow(run, ANSWER)
    return stage(found if size is None else tasks(found, size))


class Exchange(Protocol):
    """What is exchanged: a table is what a message holds, or what several hold together."""

    def read(self, blob: bytes) -> Any: ...

    def merge(self, tables: list) -> tuple[Any, list[np.ndarray]]:
        """One table of the distinct entries in order, and the place in it of each entry of each table."""

    def messages(self, table: Any, row: int, shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, blob); the shards of a row of exchanges are numbered from row * shards on."""

    def judge(self, blobs: list[bytes]) -> list[bytes]:
        """What a shard answers to each of its messages."""

    def told(self, table: Any, row: int, shards: int, own: dict[int, bytes]) -> Any:
        """The answers to the messages of a table, put together."""

    def passed(self, table: Any, merged: Any, place: np.ndarray, told: Any) -> bytes:
        """The answer to one table, of what was told to the merged one."""


def exchanged(messages: DataFrame, work: Exchange, kind: int, shards: int, chunks: int, fan: int = FAN, size: int | None = None) -> DataFrame:
    """ANSWER rows, staged, to messages for min(shards, fan) ranges (of each row of exchanges); size: see answers."""
    if shards <= fan:
        return answers(messages, work.judge, kind, size)
    mergers = -(-chunks // fan)
    spark = messages.sparkSession
    messages = stage(messages.withColumn("merger", F.col("shard") * mergers + F.pmod(F.xxhash64("chunk"), F.lit(mergers))))

    def read(table: pa.Table) -> tuple[int, list, Any, list[np.ndarray]]:
        tables = [work.read(b) for b in table.column("blob").to_pylist()]
        return table.column("shard")[0].as_py() // fan, tables, *work.merge(tables)

    def up(table: pa.Table) -> pa.Table:
        row, _, merged, _ = read(table)
        made = list(work.messages(merged, row, shards))
        merger = table.column("merger")[0].as_py()
        return pa.table([pa.array([s for s, _ in made], pa.int64()), pa.array([merger] * len(made), pa.int64()), pa.array([b for _, b in made], pa.binary())], names=["shard", "chunk", "blob"])

    above = answers(messages.groupBy("merger").applyInArrow(up, MESSAGE), work.judge, kind)

    def down(table: pa.Table, found: pa.Table) -> pa.Table:
        row, tables, merged, places = read(table)
        told = work.told(merged, row, shards, dict(zip(found.column("shard").to_pylist(), found.column("blob").to_pylist(), strict=True)))
        blobs = [work.passed(t, merged, p, told) for t, p in zip(tables, places, strict=True)]
        return pa.table([table.column("chunk").cast(pa.int64()), pa.array([kind] * len(blobs), pa.int32()), table.column("shard").cast(pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "kind", "shard", "blob"])

    return stage(messages.groupBy("merger").cogroup(above.withColumnRenamed("chunk", "merger").groupBy("merger")).applyInArrow(down, ANSWER))


def told_bits(keys: np.ndarray, row: int, shards: int, width: int, own: dict[int, bytes]) -> np.ndarray:
    """The bits for sorted keys below 2**width, one a key, from the answers of their shards."""
    owners, cuts = bounds(keys, shards, width)
    return np.concatenate([np.zeros(0, bool), *[flags(own[row * shards + s], b - a) for s, a, b in zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]])


def with_answers(chunks: DataFrame, found: DataFrame, work: Callable[[int, bytes, dict[tuple[int, int], bytes]], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """work gets (chunk, payload, answers by kind and shard) and returns the columns of the schema."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {(k, s): b for k, s, b in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "blob")), strict=True)}
        rows = [work(c, p, own) for c, p in zip(left.column("chunk").to_pylist(), left.column("payload").to_pylist(), strict=True)]
        data = [pa.concat_arrays([x[f.name] if isinstance(x[f.name], pa.Array) else pa.array(x[f.name], f.type) for x in rows]) if rows else pa.array([], f.type) for f in arrow]
        return pa.Table.from_arrays(data, schema=arrow)

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(counts.sum()))


# Exact exchange of 96-bit keys with their least document -----------------------------------------------------------


def key_messages(keys: np.ndarray, check: np.ndarray, least: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) of distinct (keys, check) in sorted order, least being the least doc_id of each."""
    owners, cuts = bounds(keys, shards, 64)
    for s, a, b in zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        deltas = np.diff(keys[a:b], prepend=np.uint64(0))
        parts = [compressed(deltas), compressed(check[a:b]), compressed(least[a:b])]
        yield s, np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def read_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(blob[:24], np.int64)
    ends = 24 + np.cumsum(sizes)
    parts = [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return np.cumsum(expanded(parts[0], np.uint64), dtype=np.uint64), expanded(parts[1], np.uint32), expanded(parts[2], np.int64)


class Least:
    """The exchange of (keys, checks, least doc_ids): whether another message has a key with a smaller doc_id."""

    read = staticmethod(read_keys)

    def merge(self, tables: list) -> tuple[tuple, list[np.ndarray]]:
        keys, check, least = (np.concatenate([t[i] for t in tables]) for i in range(3))
        order = np.lexsort((least, check, keys))
        k, c = keys[order], check[order]
        new = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))[: len(k)]
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        return (k[new], c[new], least[order][new]), np.split(place, np.cumsum([len(t[0]) for t in tables])[:-1])

    def messages(self, table: tuple, row: int, shards: int) -> Iterator[tuple[int, bytes]]:
        return key_messages(*table, shards)

    def judge(self, blobs: list[bytes]) -> list[bytes]:
        tables = [read_keys(b) for b in blobs]
        merged, places = self.merge(tables)
        return [bits(merged[2][p] < t[2]) for t, p in zip(tables, places, strict=True)]

    def told(self, table: tuple, row: int, shards: int, own: dict[int, bytes]) -> np.ndarray:
        return told_bits(table[0], row, shards, 64, own)

    def passed(self, table: tuple, merged: tuple, place: np.ndarray, told: np.ndarray) -> bytes:
        return bits(told[place] | (merged[2][place] < table[2]))


def total(chunks: DataFrame) -> tuple[int, int]:
    """(chunks, bytes)"""
    n, size = chunks.agg(F.count("chunk"), F.sum("size")).first()
    return n, size or 0


# Rolling hashes ----------------------------------------------------------------------------------------------------

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2**64 for i below n (base odd); kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, n + n // 8)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up), np.cumprod(down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base ** i; a window's hash is the difference times base ** -start."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values))[0][: len(values)], dtype=np.uint64)])


def window_hash(prefix: np.ndarray, starts: np.ndarray, size: int, base: int) -> np.ndarray:
    return mix((prefix[starts + size] - prefix[starts]) * powers(base, len(prefix))[1][starts])
