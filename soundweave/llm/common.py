"""What the corpus operators share: staging, batches and chunks of whole documents."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; a single longer document is handled alone.
GROUP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir. Where that is unset, a local one if driver and executors are
    one machine (tests); on a cluster an error, as results would be silently incomplete."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.gettempdir()}/soundweave-checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows of a few numbers for each file of a staged table.
FILE_ROWS = 1 << 14


def files(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as that many short rows need, at most those it has. Without Hadoop's native library
    each new file makes an executor start processes, which share its memory for a moment and are counted with it."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


#: Bytes of text for each task that works on a small corpus.
TASK_BYTES = 8 << 20


def tasks(df: DataFrame, size: int) -> DataFrame:
    """df in a partition for each TASK_BYTES of the size bytes of text it comes from, one a core at least, at most those it
    has: however many partitions a small corpus is dealt to, its files are few (see files)."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def stage(df: DataFrame, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and a lost executor loses nothing.

    Each call has a folder of its own, which is deleted when the driver's Python ends. rows: about how many short rows df
    has, which then set the number of files."""
    spark = df.sparkSession
    df = df if rows is None else files(df, rows)
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the cluster may be gone already
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by position, whatever other columns there are; missing ones are null.

    Column names are matched exactly, so that a clashing name in another case is another column."""
    have = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{have[n]}").alias(n) if n in have else F.lit(None).alias(n) for n in names])


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id long, text string, and more columns as strings."""
    kind = {"doc_id": "long"}
    return columns(df, "doc_id", "text", *more).select(*[F.col(c).cast(kind.get(c, "string")) for c in ("doc_id", "text", *more)])


def groups(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds at most budget bytes, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(at)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def map_groups(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text", budget: int = GROUP_BYTES) -> DataFrame:
    """mapInArrow over groups of rows; f returns the columns of the schema as lists or arrays."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, column, budget):
            yield record(f(part), arrow)

    return df.mapInArrow(run, schema)


def record(data: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := data[field.name], pa.Array) else pa.array(x, field.type) for field in arrow], schema=arrow)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as str, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, parts: int = 256, how: str = "left") -> DataFrame:
    """rows joined with table, which has a row for each key and in weight the number of rows that ask for it.

    Keys with over 1/parts of all the rows are at most parts many; they are broadcast, and their rows don't move.
    All other keys are joined by a shuffle in which none is hot. table is best staged, as it is read thrice."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    value = [c for c in table.columns if c not in (key, weight)]
    hot = F.broadcast(table.where(F.col(weight) > total / parts).select(key, F.struct(*value).alias("_hot")))
    marked = rows.join(hot, key, "left")
    done = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in value])
    rest = marked.where("_hot is null").drop("_hot").join(table.where(F.col(weight) <= total / parts).drop(weight), key, how)
    return done.unionByName(rest.select(*rows.columns, *value))


def filter_rows(docs: DataFrame, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of docs, with all their columns, whose texts (UTF-8, null as empty) keep says stay; no shuffle.

    The columns pass under other names, so that names that clash are no matter."""
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = plain.schema[at].name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, text):
            yield part.filter(pa.array(keep(raw_texts(part, text)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
