"""Dictionary files of a morphological analyser, as rows.

A file is little-endian. It begins with a header of 272 bytes; then parts of speech (a 16-bit count, six strings each),
a connection matrix (two 16-bit sizes, 16-bit costs), a trie (32-bit size, 32-bit units), a table of word ids (32-bit
size in bytes), parameters (32-bit number of words, three 16-bit numbers each, the third being the cost), the place of
each word's record (32 bits), and the records. A string is its length in UTF-16 units, in one byte or in two with the
first one's top bit set, and the units. A record is surface, head length (like a string's), part of speech (16 bits),
normalized form, a 32-bit word id and reading; more may follow.

One task cuts the file into blocks of words, which other tasks decode.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format.
HEADER, POS_STRINGS = 272, 6
BLOCK = 20_000

ROWS = "word_id string, surface string, reading string, normalized string, pos array<string>, cost int"
BLOCKS = "first long, base long, places binary, costs binary, records binary, pos array<array<string>>"


def text_at(data: bytes, at: int) -> tuple[str, int]:
    """(string, place after it)."""
    n, at = data[at], at + 1
    if n & 0x80:
        n, at = (n & 0x7F) << 8 | data[at], at + 1
    return data[at : at + 2 * n].decode("utf-16-le"), at + 2 * n


def layout(data: bytes) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(parts of speech, costs, places of the records); ValueError if the records don't begin where they should."""
    (n,), at = struct.unpack_from("<H", data, HEADER), HEADER + 2
    pos = []
    for _ in range(n):
        own = []
        for _ in range(POS_STRINGS):
            s, at = text_at(data, at)
            own.append(s)
        pos.append(own)
    left, right = struct.unpack_from("<hh", data, at)
    at += 4 + 2 * left * right
    at += 4 + 4 * struct.unpack_from("<i", data, at)[0]
    at += 4 + struct.unpack_from("<i", data, at)[0]
    (words,) = struct.unpack_from("<i", data, at)
    costs = np.frombuffer(data, "<i2", 3 * words, at + 4)[2::3]
    at += 4 + 6 * words
    places = np.frombuffer(data, "<i4", words, at)
    if words and places[0] != at + 4 * words:
        raise ValueError(f"records should begin at {at + 4 * words}, not at {places[0]}: another format")
    return pos, costs, places


def record_at(data: bytes, at: int) -> tuple[str, int, str, str]:
    """(surface, number of its part of speech, normalized, reading)."""
    surface, at = text_at(data, at)
    at += 2 if data[at] & 0x80 else 1
    (pos,) = struct.unpack_from("<H", data, at)
    normalized, at = text_at(data, at + 2)
    reading, _ = text_at(data, at + 4)
    return surface, pos, normalized, reading


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content").to_pylist():
            pos, costs, places = layout(data)
            for i in range(0, len(places), BLOCK):
                own = places[i : i + BLOCK]
                end = int(places[i + BLOCK]) if i + BLOCK < len(places) else len(data)
                base = int(own[0])
                values = [[i], [base], [own.tobytes()], [np.ascontiguousarray(costs[i : i + BLOCK]).tobytes()], [data[base:end]], [pos]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["first", "base", "places", "costs", "records", "pos"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.to_pylist():
            rows: list[list] = [[] for _ in range(6)]
            costs = np.frombuffer(block["costs"], "<i2").tolist()
            for k, at in enumerate(np.frombuffer(block["places"], "<i4").tolist()):
                surface, pos, normalized, reading = record_at(block["records"], at - block["base"])
                own = block["pos"][pos] if pos < len(block["pos"]) else []
                for column, value in zip(rows, (f"{block['first'] + k:012d}", surface, reading or surface, normalized or surface, own, costs[k]), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["word_id", "surface", "reading", "normalized", "pos", "cost"])


def read_dictionary(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """ROWS of a dictionary file (or files) in any store that Spark reads; word_id orders like the file."""
    files = spark.read.format("binaryFile").load(path).select("content")
    blocks = files.mapInArrow(_cut, BLOCKS)
    return blocks.repartition(partitions or spark.sparkContext.defaultParallelism).mapInArrow(_decode, ROWS)
