"""From dictionary rows to lexicon rows.

Dictionary rows have surface, reading, normalized, pos (array) and cost; a document-frequency table has surface and
documents. `from_documents` makes both from a table of texts: each word of Latin letters is an entry whose reading
spells it in kana.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phonology as P
from .vocabulary import with_sound

# Parts of speech that don't enter the lexicon; the categories; those searched unless asked otherwise.
EXCLUDED_POS = ["助詞", "助動詞", "補助記号", "記号", "空白", "接続詞"]
CATEGORIES = ["common", "product", "person", "place", "other"]
DEFAULT_CATEGORIES = ["common", "product", "other"]
MIN_MORA, MAX_MORA = 2, 12
TOTAL_ROW = "[TOTAL]"

# How Latin letters are spelled: first the pairs, then each letter.
LETTER_PAIRS = {"sh": "シャ", "ch": "チョ", "ts": "ツ", "tt": "ット", "ee": "イー", "ou": "オー"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_KANA = "アビクデエフゴホイジクルマンオペクルストウヴワッーゾ"


def classify(pos: Column) -> Column:
    """The category of an array of parts of speech."""
    proper = F.get(pos, 1) == "固有名詞"
    kind = F.coalesce(F.get(pos, 2), F.lit(""))
    return F.when(F.size(pos) < 2, "other").when(~proper, "common").when(kind == "人名", "person").when(kind == "地名", "place").otherwise("product")


def shown_pos(pos: Column) -> Column:
    return F.coalesce(F.get(pos, 1), F.get(pos, 0), F.lit(""))


def is_noun(pos: Column) -> Column:
    return F.get(pos, 0) == "名詞"


def is_proper_noun(category: Column) -> Column:
    return category.isin("product", "person", "place")


def parse_categories(names: list[str] | str | None) -> list[str] | None:
    """Trimmed names without blanks; None if there are none, ValueError for an unknown one."""
    parts = names.split(",") if isinstance(names, str) else list(names or [])
    found = [n.strip() for n in parts if n.strip()]
    if unknown := [n for n in found if n not in CATEGORIES]:
        raise ValueError(f"unknown category {unknown[0]!r}; valid: {', '.join(CATEGORIES)}")
    return found or None


def complete(entries: DataFrame) -> DataFrame:
    """An empty reading or normalized form is the surface."""
    fill = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("surface"))
    return entries.withColumns({"reading": fill("reading"), "normalized": fill("normalized")})


def _unpacked(batches):
    """Lines of xz files, in blocks; Spark's own readers have no such codec."""
    import io
    import lzma

    import pyarrow as pa

    for batch in batches:
        for data in batch.column("content").to_pylist():
            with lzma.open(io.BytesIO(data), "rt", encoding="utf-8") as lines:
                while block := lines.readlines(1 << 20):
                    rows = [x.rstrip("\n").rpartition("\t") for x in block if "\t" in x]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([int(r[2]) for r in rows], pa.int64())], names=["surface", "documents"])


def read_frequencies(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(surface, documents) and the corpus size from a tab-separated table, plain or packed (.xz), with a [TOTAL] row."""
    schema = "surface string, documents long"
    if path.endswith(".xz"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpacked, schema)
    else:
        rows = spark.read.csv(path, sep="\t", schema=schema, quote="")
    total = rows.where(F.col("surface") == TOTAL_ROW).agg(F.max("documents")).first()[0]
    if total is None:
        raise ValueError(f"{path} has no {TOTAL_ROW} row")
    return rows.where(F.col("surface") != TOTAL_ROW), total


def lexicon(entries: DataFrame, frequencies: DataFrame | None = None, total: int | Column | None = None, min_mora: int = MIN_MORA, max_mora: int = MAX_MORA) -> DataFrame:
    """Lexicon rows: filtered, distinct by surface and reading (the first by word_id), with sound, category and
    familiarity. Document counts come from frequencies, or from entries that carry them (column documents; those of one
    surface are added up, whichever of them stay). Filters that need only text come before anything is computed."""
    # One exchange, before the work on readings: sums, ranking and join are all by surface. A fixed number of parts, as
    # small rows with much work for each would otherwise be merged into one task.
    context = entries.sparkSession
    parts = max(context.sparkContext.defaultParallelism, int(context.conf.get("spark.sql.shuffle.partitions")))
    plain = complete(entries).repartition(parts, "surface")
    if frequencies is None:
        counts = F.sum("documents").over(Window.partitionBy("surface")) if "documents" in entries.columns else F.lit(None).cast("long")
        plain = plain.withColumn("documents", counts)
    plain = plain.where(~F.get("pos", 0).isin(EXCLUDED_POS) & P.is_searchable(F.col("surface")) & P.is_pronounceable(F.col("reading")))
    sounded = with_sound(plain).where(F.col("mora_count").between(min_mora, max_mora))
    first = F.row_number().over(Window.partitionBy("surface", "reading").orderBy("word_id"))
    one = sounded.withColumn("_n", first).where("_n = 1").drop("_n")
    counted = one.join(frequencies, "surface", "left") if frequencies is not None else one
    size = total if isinstance(total, Column) else F.lit(total)
    known = counted.withColumn("familiarity", P.familiarity(F.col("documents"), size).cast("float"))
    return known.select("surface", "reading", "normalized", shown_pos(F.col("pos")).alias("pos"), classify(F.col("pos")).alias("category"), "cost", "familiarity", "mora_count", "phon", "codes")


def spell(word: Column) -> Column:
    """Latin letters as kana."""
    for pair, kana in LETTER_PAIRS.items():
        word = F.replace(word, F.lit(pair), F.lit(kana))
    return F.translate(word, LETTERS, LETTER_KANA)


def word_counts(docs: DataFrame) -> DataFrame:
    """token, documents: words of 2 Latin letters or more and in how many documents they are. Distinct within a row first,
    so that the shuffle has a word of a document once."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= 2))
    each = docs.select("doc_id", F.explode(words).alias("token"))
    return each.groupBy("token", "doc_id").agg(F.lit(1).alias("_")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def surface_of(token: Column, reading: Column) -> Column:
    """A writing for a spelled word: its kana, hiragana, or a kanji before either."""
    hiragana = F.translate(reading, P.I.KATAKANA, P.I.HIRAGANA)
    kind = F.length(token) % 4
    return F.when(kind == 0, reading).when(kind == 1, hiragana).when(kind == 2, F.concat(F.lit("語"), hiragana)).otherwise(F.concat(F.lit("語"), token))


def pos_of(token: Column) -> Column:
    pos = lambda *x: F.array(*map(F.lit, x))
    n = F.length(token) + F.ascii(token)
    return F.when(n % 11 == 0, pos("助詞")).when(n % 11 == 1, pos("感動詞")).when(n % 5 == 1, pos("名詞", "固有名詞", "一般")).when(n % 5 == 2, pos("名詞", "固有名詞", "人名")).when(n % 5 == 3, pos("名詞", "固有名詞", "地名")).otherwise(pos("名詞", "普通名詞", "一般"))


def entries_of(counts: DataFrame) -> DataFrame:
    """Dictionary rows of counted words; word_id is the word itself."""
    t = F.col("token")
    spelled = counts.withColumn("reading", spell(t))
    return spelled.select(t.alias("word_id"), surface_of(t, F.col("reading")).alias("surface"), "reading", F.regexp_replace(t, "s$", "").alias("normalized"), pos_of(t).alias("pos"), (F.length(t) * 1000).cast("int").alias("cost"), "documents")


def frequencies_of(entries: DataFrame) -> DataFrame:
    """surface, documents of dictionary rows that carry a count; words of one surface are counted together."""
    return entries.groupBy("surface").agg(F.sum("documents").alias("documents"))


def from_documents(docs: DataFrame) -> DataFrame:
    """The lexicon of the words in a table of texts; the size of the corpus is read first (one number)."""
    return lexicon(entries_of(word_counts(docs)), total=docs.agg(F.countDistinct("doc_id")).first()[0])
