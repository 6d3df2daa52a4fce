"""One object for the four kinds of query, with checked parameters and JSON rows; and functions for SQL."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance as D
from .functions import inventory as I
from .functions import phonology as P
from .functions.scoring import PRESETS, Weights
from .operators import index as X
from .operators import phrase as H
from .operators import search as S
from .sources import lexicon as L
from .sources.vocabulary import with_sound

# Bounds of parameters.
BOUNDS = {"candidates": (1, 50_000), "min_score": (0.0, 1.0), "min_mora": (1, 32), "max_mora": (1, 32), "max_chunk": (1, 8), "keep": (1, 64), "beam": (1, 256), "least": (0.0, 1.0), "node_budget": (2, 200), "max_nodes_per_span": (1, 32)}


def checked(**values) -> dict:
    """The values that are given; ValueError for one out of its bounds."""
    for name, value in values.items():
        if value is not None and name in BOUNDS and not BOUNDS[name][0] <= value <= BOUNDS[name][1]:
            raise ValueError(f"{name} must be between {BOUNDS[name][0]} and {BOUNDS[name][1]}, not {value}")
    return {k: v for k, v in values.items() if v is not None}


class Phonetics:
    """Queries over an index. Texts are lists of strings, or what `readings` gave; results are DataFrames with query_id or phrase_id, the
    place of the text in the list."""

    def __init__(self, index: X.Index):
        self.index, self.spark = index, index.lexicon.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Phonetics:
        return cls(X.open_index(spark, path))

    def readings(self, texts: Iterable[str] | DataFrame) -> DataFrame:
        """query_id, text, reading and sound; kana as it is, other text by known surfaces. Readings are passed on."""
        if isinstance(texts, DataFrame):
            return texts
        rows = self.spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
        return with_sound(S.read_texts(rows, self.index.lexicon)).withColumnRenamed("text_id", "query_id")

    def similar(
        self, texts: Iterable[str] | DataFrame, *, limit: int = 10, preset: str = "pun", weights: Weights | None = None, candidates: int = S.CANDIDATES, min_score: float = 0.0, categories: str | list[str] | None = None,
        min_mora: int | None = None, max_mora: int | None = None, exclude_same_reading: bool = True, dedupe_by_reading: bool = True, candidate_filter: Column | None = None,
    ) -> DataFrame:
        """limit 0: all."""
        if limit < 0:
            raise ValueError("limit must not be below 0")
        how = checked(candidates=candidates, min_score=min_score, min_mora=min_mora, max_mora=max_mora)
        wanted = L.parse_categories(categories) if categories else categories
        return S.search(self.index, self.readings(texts), limit=limit or None, preset=preset, weights=weights, categories=wanted, exclude_same_reading=exclude_same_reading, dedupe_by_reading=dedupe_by_reading, candidate_filter=candidate_filter, **how)

    def similar_with_floor(self, texts: Iterable[str] | DataFrame, *, limit: int = 0, min_score: float = 0.7, **how) -> DataFrame:
        return S.search_with_floor(self.index, self.readings(texts), limit=limit, **checked(min_score=min_score, **how))

    def _phrases(self, texts: Iterable[str] | DataFrame) -> DataFrame:
        return self.readings(texts).select(F.col("query_id").alias("phrase_id"), "reading")

    def phrase(self, texts: Iterable[str] | DataFrame, *, limit: int = 10, **how) -> DataFrame:
        """how: max_chunk, keep, beam, least, allow_particles, categories."""
        return H.compose(self._phrases(texts), self.index, limit=limit, **checked(**how))

    def lattice(self, texts: Iterable[str] | DataFrame, **how) -> tuple[DataFrame, DataFrame]:
        return H.lattice(self._phrases(texts), self.index, **checked(**how))

    def pronounce(self, texts: Iterable[str] | DataFrame) -> DataFrame:
        return self.readings(texts).select("query_id", "text", P.pronunciation(F.col("reading")).alias("p")).select("query_id", "text", "p.*")

    def compare(self, pairs: Iterable[tuple[str, str]]) -> DataFrame:
        """a, b (text, reading, phonemes, ipa), similarity, distance and spaces for each pair."""
        pairs = list(pairs)
        side = self.readings([t for p in pairs for t in p]).withColumn("pair", F.floor(F.col("query_id") / 2)).withColumn("side", F.col("query_id") % 2)
        one = lambda n, name: side.where(F.col("side") == n).select("pair", F.col("text").alias(f"text_{name}"), F.col("reading").alias(f"reading_{name}"))
        done = S.compare(one(0, "a").join(one(1, "b"), "pair"))
        part = lambda n: F.struct(F.col(f"text_{n}").alias("text"), F.col(f"reading_{n}").alias("reading"), P.phonemes(F.col(f"reading_{n}")).alias("phonemes"), P.ipa(P.codes(F.col(f"reading_{n}"))).alias("ipa"))
        spaces = ("phonetic", "consonant", "coda", "rhythm", "vowel")
        return done.select("pair", part("a").alias("a"), part("b").alias("b"), "similarity", "distance", F.struct(*spaces).alias("spaces"))

    def align(self, a: list[str], b: list[str]) -> tuple[list[dict], float]:
        """The pairs of an alignment of two lists of phonemes, and their total cost."""
        pairs = D.align(a, b)
        return pairs, H.four(sum(p["distance"] for p in pairs))

    def info(self) -> DataFrame:
        return X.info(self.index)

    def presets(self) -> DataFrame:
        return self.spark.createDataFrame([(n, c, getattr(w, c)) for n, w in PRESETS.items() for c in w.__dataclass_fields__], "preset string, component string, weight double")

    def phonemes(self) -> DataFrame:
        """symbol, kind, ipa and features of each phoneme."""
        rows = [(s, "consonant", v["ipa"], v["place"], v["manner"], v["voiced"], v["palatalized"], None, None, None) for s, v in I.CONSONANTS.items()]
        rows += [(s, "vowel", v["ipa"], None, None, None, None, v["height"], v["backness"], v["rounded"]) for s, v in I.VOWELS.items()]
        rows += [(s, "special", v["ipa"], *[None] * 7) for s, v in I.SPECIALS.items()]
        return self.spark.createDataFrame(rows, "symbol string, kind string, ipa string, place string, manner string, voiced boolean, palatalized boolean, height int, backness int, rounded boolean")


def as_json(df: DataFrame, id_column: str = "query_id") -> DataFrame:
    """id_column and json: the other columns of each row as one object."""
    return df.select(id_column, F.to_json(F.struct(*[c for c in df.columns if c != id_column])).alias("json"))


def register(spark: SparkSession, prefix: str = "sound") -> list[str]:
    """Functions for SQL: PREFIX_codes, PREFIX_distance, PREFIX_similarity (of readings) and the table function
    PREFIX_align (of phonemes with spaces between). Their names are returned."""
    import re

    def code_of(reading: str | None) -> str | None:
        if reading is None:
            return None
        return "".join(I.KANA_CODES[m] for m in re.findall(I.MORA_PATTERN, reading.translate(str.maketrans(I.HIRAGANA, I.KATAKANA))))

    @F.pandas_udf("string")
    def codes(readings: pd.Series) -> pd.Series:
        return readings.map(code_of, na_action="ignore")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(D.edit_distances([code_of(x) or "" for x in a], [code_of(x) or "" for x in b])).where((a.notna() & b.notna()).to_numpy(), None)

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        left, right = [code_of(x) or "" for x in a], [code_of(x) or "" for x in b]
        out = []
        for x, y, d in zip(left, right, D.edit_distances(left, right), strict=True):
            top = min(len(x), len(y)) * D.WORST + abs(len(x) - len(y)) * D.INDEL
            out.append(1.0 if not x and not y else 0.0 if not x or not y else max(0.0, 1 - d / top))
        return pd.Series(out).where((a.notna() & b.notna()).to_numpy(), None)

    @F.udtf(returnType="a: string, b: string, distance: double, op: string")
    class Align:
        def eval(self, a: str, b: str):
            for p in D.align(a.split(), b.split()):
                yield p["a"], p["b"], p["distance"], p["op"]

    for name, f in (("codes", codes), ("distance", distance), ("similarity", similarity)):
        spark.udf.register(f"{prefix}_{name}", f)
    spark.udtf.register(f"{prefix}_align", Align)
    return [f"{prefix}_{n}" for n in ("codes", "distance", "similarity", "align")]
