"""Words that sound like a query, comparison of two words, and readings.

A search takes a batch of queries. One pass over the sounds (a partition-pruned scan) gives each query the nearest
sounds by quantised vectors and the sounds that hold it; only these meet the words. Edit distances are computed for
sounds, not words. The best per query come from a ranking by query, of which Spark computes partial limits first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import embedding as E
from ..functions import phonology as P
from ..functions.scoring import Weights, weights_of
from ..sources.lexicon import CATEGORIES, DEFAULT_CATEGORIES
from ..sources.staging import small
from ..sources.vocabulary import with_sound
from .index import Index, mora_range

# How many sounds are candidates, and by how many moras they may differ.
CANDIDATES, MORA_GAP = 8000, 3
#: Queries handled in one pass over the sounds.
BLOCK = 256

FOUND = "query_id long, mora_count int, phon string, codes string, skeleton string, dot long, ratio double, coda_dot long"


def queries_of(spark: SparkSession, texts: Iterable[tuple[int, str, str]]) -> DataFrame:
    """query_id, text, reading, codes, phon, mora_count from (query_id, text, reading)."""
    return with_sound(spark.createDataFrame(list(texts), "query_id long, text string, reading string").withColumn("reading", P.to_katakana(F.col("reading"))))


def _blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str, int]]]:
    block: list[tuple[int, str, int]] = []
    for row in queries.select("query_id", "codes", "mora_count").where("codes <> ''").toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


class _Best:
    """The rows of one query with the greatest dot products that a partition has seen, as arrays; ties are settled later."""

    def __init__(self, keep: int):
        self.keep, self.dots, self.places, self.ratios, self.codas = keep, *(np.zeros(0, k) for k in (np.int64, np.int64, np.float64, np.int64))

    def add(self, dots: np.ndarray, places: np.ndarray, ratios: np.ndarray, codas: np.ndarray) -> None:
        self.dots, self.places, self.ratios, self.codas = (np.concatenate(x) for x in ((self.dots, dots), (self.places, places), (self.ratios, ratios), (self.codas, codas)))
        if len(self.dots) > 4 * self.keep:
            self.cut()

    def cut(self) -> None:
        if len(self.dots) > self.keep:
            at = np.flatnonzero(self.dots >= np.partition(self.dots, -self.keep)[-self.keep])
            self.dots, self.places, self.ratios, self.codas = (x[at] for x in (self.dots, self.places, self.ratios, self.codas))


_SOUND = ("mora_count", "phon", "codes", "skeleton")


def _found_rows(sounds: pa.Table, query: int, places: np.ndarray, dots: np.ndarray | None, ratios: np.ndarray, codas: np.ndarray) -> pa.RecordBatch:
    own = sounds.take(pa.array(places)).combine_chunks()
    n = len(places)
    columns = [pa.array([query] * n, pa.int64()), *(own.column(c).combine_chunks() for c in _SOUND), pa.nulls(n, pa.int64()) if dots is None else pa.array(dots), pa.array(ratios), pa.array(codas)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", *_SOUND, "dot", "ratio", "coda_dot"])


def candidate_sounds(index: Index, queries: DataFrame, candidates: int = CANDIDATES, contained: bool = True, ranged: bool = False, bounds: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """FOUND rows: per query the sounds that are near (dot is set) or hold the query (ratio over 0).

    ranged: all sounds of the range, without a limit."""
    spark = queries.sparkSession
    scales = {s: index.scale(s) for s in E.INDEXED}
    out = None
    for block in _blocks(queries):
        vectors = {s: E.quantize_array(E.VECTORS[s]([c for _, c, _ in block]), scales[s]) for s in E.INDEXED}
        sent = spark.sparkContext.broadcast((block, vectors))  # BLOCK queries at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, vecs = sent.value
            patterns = [re.compile(D.containment_pattern(c)) for _, c, _ in own]
            best, seen, before = [_Best(candidates) for _ in own], [], 0  # seen: names of the partition's sounds, without vectors
            for batch in batches:
                if not batch.num_rows:
                    continue
                sounds = pa.Table.from_batches([batch]).select(list(_SOUND))
                moras, codes = batch.column("mora_count").to_numpy(), batch.column("codes").to_pylist()
                flat = {s: batch.column(f"vec_{s}").flatten().to_numpy().reshape(len(moras), -1).astype(np.float32) for s in E.INDEXED}
                dots = {s: (flat[s] @ vecs[s].astype(np.float32).T).astype(np.int64) for s in E.INDEXED}  # below 2**24: exact
                lines, lengths = "\n".join(codes), np.fromiter(map(len, codes), np.int64, len(codes))
                ends = np.cumsum(lengths + 1)
                for q, (query, code, count) in enumerate(own):
                    ratio = np.zeros(len(moras))
                    if contained:
                        held = np.searchsorted(ends, [m.start() for m in patterns[q].finditer(lines)], "right").astype(np.int64)
                        ratio[held] = len(code) / lengths[held]
                    dot, coda = dots["phonetic"][:, q], dots["coda"][:, q]
                    if ranged:
                        yield _found_rows(sounds, query, np.arange(len(moras)), dot, ratio, coda)
                        continue
                    near = np.flatnonzero(np.abs(moras - count) <= MORA_GAP)
                    if len(near) > candidates:
                        d = dot[near]
                        near = near[d >= np.partition(d, -candidates)[-candidates]]
                    best[q].add(dot[near], near + before, ratio[near], coda[near])
                    # Whether near or not: one that holds the query must outlive the cut.
                    if len(sure := np.flatnonzero(ratio)):
                        yield _found_rows(sounds, query, sure, None, ratio[sure], coda[sure])
                if not ranged:
                    seen.append(sounds)
                    before += len(moras)
            if seen:
                sounds = pa.concat_tables(seen)
                for b, (query, _, _) in zip(best, own, strict=True):
                    b.cut()
                    if len(b.dots):
                        yield _found_rows(sounds, query, b.places, b.dots, b.ratios, b.codas)

        sounds = mora_range(index.groups, *bounds) if ranged else index.groups
        if not ranged and not contained:
            counts = [m for _, _, m in block]
            sounds = mora_range(sounds, min(counts) - MORA_GAP, max(counts) + MORA_GAP)
        part = sounds.select("mora_count", "phon", "codes", "skeleton", *[f"vec_{s}" for s in E.INDEXED]).mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], FOUND)
    if ranged:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), "mora_count", "phon"))
    top = out.where("dot is not null").withColumn("_r", rank).where(F.col("_r") <= candidates).drop("_r")
    holds = out.where("dot is null").join(top.select("query_id", "phon"), ["query_id", "phon"], "left_anti")
    return top.unionByName(holds) if contained else top


def scored_sounds(index: Index, queries: DataFrame, weights: Weights, **how) -> DataFrame:
    """The candidates with the components that depend on the sound alone."""
    found = candidate_sounds(index, queries, contained=weights.containment > 0, **how)
    asked = queries.select("query_id", F.col("text").alias("query_text"), F.col("reading").alias("query_reading"), F.col("codes").alias("query_codes"), F.col("mora_count").alias("query_moras"))
    asked = asked.withColumn("query_skeleton", P.vowel_skeleton(F.col("query_codes")))
    both = found.join(asked, "query_id")
    sim = lambda a, b: D.similarity(D.edit_distance(F.col(a), F.col(b)), F.length(a), F.length(b))
    phonetic, coda = index.scale("phonetic") ** 2, index.scale("coda") ** 2
    return both.select(
        "*",
        F.when(F.lit(weights.containment > 0) & (F.col("ratio") > 0), 1.0).otherwise(sim("query_codes", "codes")).alias("c_phonetic"),
        sim("query_skeleton", "skeleton").alias("c_vowel"),
        F.greatest(F.lit(0.0), F.coalesce(F.col("dot"), F.lit(0)) * phonetic).alias("c_embedding"),
        F.greatest(F.lit(0.0), F.col("coda_dot") * coda).alias("c_coda"),
        D.mora_similarity(F.col("query_moras"), F.col("mora_count")).alias("c_mora"),
        F.col("ratio").alias("c_containment"),
    )


def total_score(weights: Weights) -> Column:
    """The weighted sum, always in one order."""
    out = F.lit(0.0)
    for name in ("phonetic", "embedding", "mora", "coda", "vowel", "familiarity", "containment"):
        out = out + F.lit(getattr(weights, name)) * F.col(f"c_{name}")
    return out


def search(
    index: Index, queries: DataFrame, *, limit: int | None = 10, preset: str = "pun", weights: Weights | None = None, candidates: int = CANDIDATES, min_score: float = 0.0, categories: list[str] | None = None,
    min_mora: int | None = None, max_mora: int | None = None, exclude_same_reading: bool = True, dedupe_by_reading: bool = True, candidate_filter: Column | None = None, keep_raw: bool = False,
) -> DataFrame:
    """query_id, rank, word, reading, score and its components for each query, best first.

    A range of moras replaces the nearest candidates by all sounds in the range. An empty list of categories, or only
    unknown ones, gives nothing; None stands for the usual ones. candidate_filter is a condition on the result's
    columns. Of words that sound alike one stays, judged over all candidates; then the limit counts. keep_raw: with raw_score,
    the score before rounding."""
    w = weights_of(preset, weights)
    ranged = min_mora is not None or max_mora is not None
    wanted = DEFAULT_CATEGORIES if categories is None else [c for c in categories if c in CATEGORIES]
    sounds = scored_sounds(index, queries, w, candidates=candidates, ranged=ranged, bounds=(min_mora, max_mora))
    words = index.lexicon.where(F.col("category").isin(wanted) if wanted else F.lit(False)).select("mora_count", "phon", "surface", "reading", "normalized", "pos", "category", F.col("familiarity").cast("double").alias("c_familiarity"))
    rows = sounds.join(words, ["mora_count", "phon"]).withColumn("raw_score", total_score(w))
    if min_score > 0:
        rows = rows.where(F.col("raw_score") >= min_score)
    # A query's own word is left out in its normal form too.
    if "normalized" in queries.columns:
        asked = queries.select(F.col("text").alias("query_text"), F.col("normalized").alias("query_normal")).distinct()
    else:
        texts = small(queries.select(F.col("text").alias("query_text")).distinct())
        own = index.lexicon.select(F.col("surface").alias("query_text"), "normalized").join(texts, "query_text")
        asked = own.groupBy("query_text").agg(F.min("normalized").alias("query_normal"))
    rows = rows.join(asked, "query_text", "left").where((F.col("surface") != F.col("query_text")) & ~F.col("surface").eqNullSafe(F.col("query_normal")))
    if exclude_same_reading:
        rows = rows.where(F.col("reading") != F.col("query_reading"))
    four = lambda n: P.round4(F.col(f"c_{n}"))
    rows = rows.select(
        "query_id", F.col("surface").alias("word"), "reading", P.round4(F.col("raw_score")).alias("score"), four("phonetic").alias("phonetic_similarity"), four("embedding").alias("embedding_similarity"), four("coda").alias("coda_similarity"),
        four("vowel").alias("vowel_similarity"), four("mora").alias("mora_similarity"), four("containment").alias("containment"), "mora_count", "category", "pos", P.round3(F.col("c_familiarity")).alias("familiarity"), "codes", *(["raw_score"] if keep_raw else []),
    )
    if candidate_filter is not None:
        rows = rows.where(candidate_filter)
    if dedupe_by_reading:
        told = P.informativeness(F.col("word"), F.col("reading"))
        first = F.row_number().over(Window.partitionBy("query_id", "reading").orderBy(told.desc(), F.desc("score"), F.desc("familiarity"), F.desc("word")))
        rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "mora_count", "word", "reading"))
    rows = rows.withColumn("rank", order)
    if limit:
        rows = rows.where(F.col("rank") <= limit)
    return rows.withColumn("phonemes", P.symbols(F.col("codes"))).withColumn("ipa", P.ipa(F.col("codes"))).drop("codes")


def search_with_floor(index: Index, queries: DataFrame, *, limit: int = 0, min_score: float = 0.7, **how) -> DataFrame:
    """Queries whose results the floor would empty are answered without it, 20 rows at most; below_floor marks them. The
    floor holds for scores before rounding."""
    full = search(index, queries, limit=None, keep_raw=True, **how)
    best = F.max("raw_score").over(Window.partitionBy("query_id"))
    marked = full.withColumn("below_floor", best < min_score)
    kept = marked.where(F.col("below_floor") | (F.col("raw_score") >= min_score))
    low = min(limit, 20) if limit else 20
    most = F.when(F.col("below_floor"), low).otherwise(limit or 2**31 - 1)
    return kept.where(F.col("rank") <= most).drop("raw_score")


def compare(pairs: DataFrame) -> DataFrame:
    """distance, similarity and the similarity in each space, for columns reading_a and reading_b of pairs."""
    df = pairs.withColumns({"_a": P.codes(F.col("reading_a")), "_b": P.codes(F.col("reading_b"))})
    df = df.withColumns({"_sa": P.vowel_skeleton(F.col("_a")), "_sb": P.vowel_skeleton(F.col("_b"))})
    for space in E.DIMS:
        df = df.withColumns({f"_{space}_a": E.embed(F.col("_a"), space), f"_{space}_b": E.embed(F.col("_b"), space)})
    df = df.withColumn("_d", D.edit_distance(F.col("_a"), F.col("_b"))).withColumn("_v", D.edit_distance(F.col("_sa"), F.col("_sb")))
    gap = F.sqrt(F.aggregate(F.zip_with("_rhythm_a", "_rhythm_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    rhythm = F.greatest(F.lit(0.0), 1 - gap)
    cosine = lambda s: P.round4(E.dot_double(F.col(f"_{s}_a"), F.col(f"_{s}_b")))
    return df.select(
        *pairs.columns,
        P.round4(D.similarity(F.col("_d"), F.length("_a"), F.length("_b"))).alias("similarity"),
        P.round4(F.col("_d")).alias("distance"),
        cosine("phonetic").alias("phonetic"), cosine("consonant").alias("consonant"), cosine("coda").alias("coda"),
        P.round4(rhythm).alias("rhythm"),
        P.round4(D.similarity(F.col("_v"), F.length("_sa"), F.length("_sb"))).alias("vowel"),
    )


def nearest_vectors(rows: DataFrame, asked: Column, keep: int, size: int = BLOCK) -> DataFrame:
    """query_id, vec_id, dot from rows (vec_id, q of whole numbers): for each row that is asked the keep rows of greatest
    dot product, ties by vec_id. One pass over the rows for a block of size queries; each batch gives its best."""
    queries, out = rows.where(asked).select("vec_id", "q"), None
    schema = "query_id long, vec_id long, dot long"

    def pass_of(block: list) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(([r[0] for r in block], np.array([list(r[1]) for r in block], np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            for batch in batches:
                if batch.num_rows:
                    own = batch.column("vec_id").cast(pa.int64()).to_numpy()
                    dots = np.array(batch.column("q").to_pylist(), np.int64) @ vectors.T
                    for k, query in enumerate(ids):
                        best = np.lexsort((own, -dots[:, k]))[:keep]
                        yield pa.record_batch([pa.array([query] * len(best), pa.int64()), pa.array(own[best]), pa.array(dots[best, k])], names=["query_id", "vec_id", "dot"])

        return rows.select("vec_id", "q").mapInArrow(run, schema)

    block: list = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            found, block = pass_of(block), []
            out = found if out is None else out.unionByName(found)
    if block or out is None:
        found = pass_of(block) if block else rows.sparkSession.createDataFrame([], schema)
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dot"), "vec_id"))
    return out.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")


def read_texts(texts: DataFrame, lexicon: DataFrame, longest: int = 12) -> DataFrame:
    """texts (text_id, text) with reading and normalized. Kana are read as they are. Other text is cut into the longest
    known surfaces from the left, kana between them standing for themselves; characters that aren't known are skipped in
    the reading and stay in the normal form."""
    kana_only, one_kana = "^[\\u3041-\\u3096\\u30A1-\\u30FAー]+$", "^[\\u3041-\\u3096\\u30A1-\\u30FAー]$"
    clean = texts.select("text_id", F.trim("text").alias("text"))
    at = clean.select("text_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")))).alias("at"))
    piece = at.select("text_id", "text", "at", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size")).where(F.col("at") + F.col("size") - 1 <= F.length("text"))
    piece = piece.withColumn("surface", F.substring("text", F.col("at"), F.col("size")))
    known = lexicon.groupBy("surface").agg(F.min_by(F.struct("reading", "normalized"), F.struct("cost", "reading", "normalized")).alias("found"))
    plain = F.struct(F.when(F.col("surface").rlike(one_kana), P.to_katakana(F.col("surface"))).otherwise("").alias("reading"), F.col("surface").alias("normalized"))
    best = piece.join(known, "surface", "left").withColumn("found", F.coalesce("found", F.when(F.col("size") == 1, plain))).where("found is not null")
    best = best.groupBy("text_id", "text", "at").agg(F.max(F.struct("size", "found")).alias("b"))
    steps = best.groupBy("text_id", "text").agg(F.sort_array(F.collect_list(F.struct("at", "b.size", "b.found"))).alias("steps"))
    start = F.struct(F.lit(1).alias("next"), F.lit("").alias("reading"), F.lit("").alias("normalized"))

    def walk(s: Column, x: Column) -> Column:
        taken = F.struct((x["at"] + x["size"]).alias("next"), F.concat(s["reading"], x["found"]["reading"]).alias("reading"), F.concat(s["normalized"], x["found"]["normalized"]).alias("normalized"))
        return F.when(x["at"] >= s["next"], taken).otherwise(s)

    walked = steps.withColumn("w", F.aggregate("steps", start, walk))
    read = clean.join(walked.select("text_id", "text", "w"), ["text_id", "text"], "left")
    reading = F.when(F.col("text").rlike(kana_only), P.to_katakana(F.col("text"))).otherwise(F.coalesce("w.reading", F.lit("")))
    return read.select("text_id", "text", reading.alias("reading"), F.coalesce("w.normalized", F.col("text")).alias("normalized"))
