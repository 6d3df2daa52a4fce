"""The phonetic index: lexicon rows, one row of vectors for each distinct sound, and what is needed to read them.

Both tables are partitioned by mora_count, so that a band of lengths reads only its folders, and are sorted by sound
within it. A sound's vectors depend on its codes alone: words that sound alike share them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..functions import phonology as P

VERSION = 1


@dataclass
class Index:
    lexicon: DataFrame
    groups: DataFrame
    meta: dict

    def scale(self, space: str) -> float:
        if space not in self.meta["scales"]:
            raise ValueError(f"space {space!r} isn't indexed; there are {', '.join(self.meta['scales'])}")
        return self.meta["scales"][space]


def distinct_sounds(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("mora_count", "phon").agg(F.first("codes").alias("codes"), F.count(F.lit(1)).alias("words"))


def sound_vectors(lexicon: DataFrame) -> DataFrame:
    """mora_count, phon, codes, words, skeleton and a float vector for each indexed space."""
    sounds = distinct_sounds(lexicon).withColumn("skeleton", P.vowel_skeleton(F.col("codes")))
    return sounds.withColumns({f"raw_{s}": E.embed(F.col("codes"), s) for s in E.INDEXED})


def quantized(vectors: DataFrame, scales: dict[str, float]) -> DataFrame:
    made = vectors.withColumns({f"vec_{s}": E.quantize(F.col(f"raw_{s}"), F.lit(scales[s])) for s in E.INDEXED})
    return made.drop(*[f"raw_{s}" for s in E.INDEXED])


def default_path() -> str:
    """Where an index is looked for if no path is given."""
    return str(Path.home() / ".cache" / "soundweave" / "index")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at) and len(files.listStatus(at)) > 0


def build(lexicon: DataFrame, path: str, *, force: bool = False, progress: Callable[[str], None] = lambda _: None) -> int:
    """Write the index of a lexicon; the number of rows. It is written beside the path and then moved there, so that a build
    that fails leaves an old index as it is. An old one is only replaced with force."""
    spark = lexicon.sparkSession
    if not force and exists(spark, path):
        raise FileExistsError(f"there is an index at {path}; force replaces it")
    new = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    files, at = _file_system(spark, new)
    try:
        progress("lexicon")
        lexicon.repartition("mora_count", "phon").sortWithinPartitions("mora_count", "phon", "surface").write.partitionBy("mora_count").parquet(f"{new}/lexicon")
        rows = spark.read.parquet(f"{new}/lexicon")
        progress("vectors")
        sound_vectors(rows).write.parquet(f"{new}/vectors")
        vectors = spark.read.parquet(f"{new}/vectors")
        scales = {s: v for (s, v) in zip(E.INDEXED, E.peak(vectors, *[f"raw_{s}" for s in E.INDEXED]).values(), strict=True)}
        progress("sounds")
        quantized(vectors, scales).sortWithinPartitions("mora_count", "phon").write.partitionBy("mora_count").parquet(f"{new}/groups")
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{new}/vectors"), True)
        counts = rows.groupBy("category").count().collect()  # a row a category
        meta = {"version": VERSION, "count": sum(r["count"] for r in counts), "scales": scales, "dims": {s: E.DIMS[s] for s in E.INDEXED}, "categories": {r["category"]: r["count"] for r in counts}}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.json(f"{new}/meta")
        progress("done")
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        files.delete(old, True)
        if not files.rename(at, old):
            raise OSError(f"{new} can't be moved to {path}")
    except BaseException:
        files.delete(at, True)
        raise
    return meta["count"]


def open_index(spark: SparkSession, path: str) -> Index:
    """ValueError for an index of another version, or whose vectors are of other lengths than this version's."""
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    if meta["version"] != VERSION:
        raise ValueError(f"index version {meta['version']}; this is version {VERSION}")
    groups = spark.read.parquet(f"{path}/groups")
    one = groups.select(*[F.size(f"vec_{s}").alias(s) for s in E.INDEXED]).first()
    for space in E.INDEXED:
        if meta["dims"].get(space) != E.DIMS[space] or (one and one[space] != E.DIMS[space]):
            raise ValueError(f"vectors of {space} don't have {E.DIMS[space]} numbers")
    return Index(spark.read.parquet(f"{path}/lexicon"), groups, meta)


def info(index: Index) -> DataFrame:
    """name, value rows about an index."""
    spark = index.lexicon.sparkSession
    rows = [("version", str(index.meta["version"])), ("count", str(index.meta["count"]))]
    rows += [(f"category.{k}", str(v)) for k, v in sorted(index.meta["categories"].items())] + [(f"dim.{k}", str(v)) for k, v in index.meta["dims"].items()]
    return spark.createDataFrame(rows, "name string, value string")


def mora_histogram(lexicon: DataFrame) -> DataFrame:
    """mora_count, words, and the number of words that are shorter. The running sum is over a row a length."""
    counts = lexicon.groupBy("mora_count").agg(F.count(F.lit(1)).alias("words"))
    before = Window.orderBy("mora_count").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("shorter", F.coalesce(F.sum("words").over(before), F.lit(0)))


def category_counts(lexicon: DataFrame) -> DataFrame:
    return lexicon.groupBy("category").agg(F.count(F.lit(1)).alias("words"))


def mora_range(df: DataFrame, least: int | None, most: int | None) -> DataFrame:
    if least is not None and most is not None and least > most:
        raise ValueError(f"min_mora {least} is over max_mora {most}")
    if least is not None:
        df = df.where(F.col("mora_count") >= least)
    return df.where(F.col("mora_count") <= most) if most is not None else df


def entries_of(index: Index, surfaces: DataFrame) -> DataFrame:
    """The lexicon rows of the given surfaces (column surface)."""
    return index.lexicon.join(surfaces.select("surface").distinct(), "surface", "left_semi")
