"""Sound vectors of code strings, their quantised form, and dot products.

A vector depends on the phonemes alone, so it is computed for each distinct code string, in numpy, all strings of one
length at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inventory as I
from .distance import matrix

CONSONANT_BLOCK = len(I.PLACES) + len(I.MANNERS) + 2
BLOCK = CONSONANT_BLOCK + 3 + 3 + 3
DIMS = {"phonetic": 3 * BLOCK, "consonant": 3 * CONSONANT_BLOCK, "coda": 2 * BLOCK, "rhythm": 8}
INDEXED = ("phonetic", "coda")
# Scales of the pooled parts, moras at the end, the rhythm's bins and longest word.
SCALES, CODA_MORAS, RHYTHM_BINS, LONGEST = (1, 2), 2, 4, 12


def _features() -> np.ndarray:
    out = np.zeros((len(I.SYMBOLS) + 1, BLOCK))
    for i, s in enumerate(I.SYMBOLS):
        if s in I.CONSONANTS:
            c = I.CONSONANTS[s]
            out[i, I.PLACES.index(c["place"])] = 1
            out[i, len(I.PLACES) + I.MANNERS.index(c["manner"])] = 1
            out[i, CONSONANT_BLOCK - 2 : CONSONANT_BLOCK] = c["voiced"], c["palatalized"]
            kind = 0
        elif s in I.VOWELS:
            v = I.VOWELS[s]
            out[i, CONSONANT_BLOCK : CONSONANT_BLOCK + 3] = v["height"] / 2, v["backness"] / 2, v["rounded"]
            kind = 1
        else:
            out[i, CONSONANT_BLOCK + 3 + list(I.SPECIALS).index(s)] = 1
            kind = 2
        out[i, BLOCK - 3 + kind] = 1
    return out


FEATURES = _features()


def spans(length: int, parts: int) -> list[tuple[int, int]]:
    """Equal parts of a sequence; a part that would be empty is its nearest element."""
    cuts = [length * i // parts for i in range(parts + 1)]
    return [(a, b) if b > a else (min(a, length - 1), min(a, length - 1) + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pooled(rows: np.ndarray) -> np.ndarray:
    """(n, length, dims) to (n, 3 * dims): the mean of the whole and of either half."""
    n, length, dims = rows.shape
    if length == 0:
        return np.zeros((n, 3 * dims))
    return np.concatenate([rows[:, a:b].mean(axis=1) for parts in SCALES for a, b in spans(length, parts)], axis=1)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _by_length(keys: list[str], width: int, one) -> np.ndarray:
    out = np.zeros((len(keys), width))
    if not keys:
        return out
    ids, lengths = matrix(keys)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[at] = one(ids[at, :n])
    return out


def phonetic_vectors(keys: list[str]) -> np.ndarray:
    return unit(_by_length(keys, DIMS["phonetic"], lambda ids: _pooled(FEATURES[ids])))


def consonant_vectors(keys: list[str]) -> np.ndarray:
    only = ["".join(c for c in k if c in I.CONSONANT_CODES) for k in keys]
    return unit(_by_length(only, DIMS["consonant"], lambda ids: _pooled(FEATURES[ids][:, :, :CONSONANT_BLOCK])))


def split_moras(key: str) -> list[str]:
    out, held = [], ""
    for c in key:
        held += c
        if c not in I.CONSONANT_CODES:
            out.append(held)
            held = ""
    return out


def coda_vectors(keys: list[str]) -> np.ndarray:
    """The mean features of each of the last moras, to the right."""
    out = np.zeros((len(keys), CODA_MORAS, BLOCK))
    for at in range(1, CODA_MORAS + 1):
        own = [m[-at] if len(m := split_moras(k)) >= at else "" for k in keys]
        out[:, CODA_MORAS - at] = _by_length(own, BLOCK, lambda ids: FEATURES[ids].mean(axis=1) if ids.shape[1] else np.zeros((len(ids), BLOCK)))
    return unit(out.reshape(len(keys), -1))


def rhythm_vectors(keys: list[str]) -> np.ndarray:
    """The number of moras, shares of specials, and where they stand; not of unit length."""
    out = np.zeros((len(keys), DIMS["rhythm"]))
    for row, k in zip(out, keys, strict=True):
        moras = [m if m in I.SPECIALS else "" for m in split_moras(k)]
        if moras:
            n = len(moras)
            row[0] = min(n, LONGEST) / LONGEST
            row[1:4] = [moras.count(s) / n for s in I.SPECIALS]
            row[4:] = [sum(map(bool, moras[a:b])) / (b - a) for a, b in spans(n, RHYTHM_BINS)]
    return out


VECTORS = {"phonetic": phonetic_vectors, "consonant": consonant_vectors, "coda": coda_vectors, "rhythm": rhythm_vectors}


def embed(code: Column, space: str) -> Column:
    """array<double> of one space."""
    make = VECTORS[space]

    @F.pandas_udf("array<double>")
    def kernel(keys: pd.Series) -> pd.Series:
        return pd.Series(list(make(keys.fillna("").tolist())))

    return kernel(code)


def peak(df: DataFrame, *names: str) -> dict[str, float]:
    """The largest absolute value in each array column, as quantisation scale (1 where all are zero)."""
    row = df.agg(*[F.max(F.array_max(F.transform(n, F.abs))).alias(n) for n in names]).first()
    return {n: (row[n] / 127 if row[n] else 1.0) for n in names}


def quantize(vector: Column, scale: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / scale).cast("int"))).cast("tinyint"))


def dequantize(vector: Column, scale: Column) -> Column:
    return F.transform(vector, lambda x: x * scale)


def dot(a: Column, b: Column) -> Column:
    """The dot product in the type that zip_with's product has, summed as long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def dot_double(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def quantize_array(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.rint(rows / scale), -127, 127).astype(np.int8)
