"""The registered queries over the driver's tables, with their SQL.

The lexicon comes from the words of `documents`; queries for search are the names in `region` and `nation`, spelled in
kana. Every query reads its whole tables. The index of a folder of tables is written once a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import embedding as E
from ..functions import inventory as I
from ..functions import phonology as P
from ..operators import index as X
from ..operators import phrase as H
from ..operators import search as S
from ..sources import lexicon as L
from ..sources import staging, vocabulary
from . import oracles as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_of(spark: SparkSession, sf_dir: str) -> X.Index:
    path = staging.kept(spark, ("index", sf_dir, staging.state_of(spark, f"{sf_dir}/documents.parquet")), lambda p: X.build(L.from_documents(table(spark, sf_dir, "documents")), p))
    return X.open_index(spark, path)


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted words, written once a session like the index."""
    path = staging.kept(spark, ("counts", sf_dir, staging.state_of(spark, f"{sf_dir}/documents.parquet")), lambda p: L.word_counts(table(spark, sf_dir, "documents")).write.parquet(p))
    return spark.read.parquet(path)


def readings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_of(spark, sf_dir).select("token", L.spell(F.col("token")).alias("reading")).withColumn("codes", P.codes(F.col("reading")))


def letters(c: str) -> F.Column:
    return L.spell(F.regexp_replace(F.lower(c), "[^a-z]", ""))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries: query_id, text, reading and their sound."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("text"), letters("r_name").alias("reading"))
    return vocabulary.with_sound(rows)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("text"), letters("n_name").alias("reading"))
    return vocabulary.with_sound(rows)


_NATION = f"nations AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, {O.spell(chr(114) + 'egexp_replace(lower(n_name), ' + chr(39) + '[^a-z]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS reading FROM nation), sounded_nations AS (SELECT *, {O.codes('reading')} AS codes FROM nations)"


# Sources and lexicon -------------------------------------------------------------------------------------------------


@register(f"WITH {O.TOKENS} SELECT token, documents FROM counts")
def word_documents(spark, sf_dir):
    return L.word_counts(table(spark, sf_dir, "documents"))


@register(f"WITH {O.ENTRIES} SELECT word_id, surface, reading, normalized, pos[1] AS pos_first, cost FROM entries")
def dictionary_entries(spark, sf_dir):
    return L.complete(L.entries_of(counts_of(spark, sf_dir))).select("word_id", "surface", "reading", "normalized", F.get("pos", 0).alias("pos_first"), "cost")


@register(O.with_lexicon("SELECT surface, reading, normalized, pos, category, cost, familiarity::DOUBLE AS familiarity, mora_count, phon, codes FROM lexicon"))
def lexicon_build(spark, sf_dir):
    return L.from_documents(table(spark, sf_dir, "documents")).withColumn("familiarity", F.col("familiarity").cast("double"))


@register(f"WITH {O.ENTRIES}, f AS (SELECT surface, sum(documents)::BIGINT AS documents FROM entries GROUP BY surface) SELECT surface, documents, {O.four(O.familiarity('documents', '(SELECT count(DISTINCT doc_id) FROM documents)'))} AS familiarity FROM f")
def familiarity(spark, sf_dir):
    counted = L.frequencies_of(L.entries_of(counts_of(spark, sf_dir)))
    total = table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("total"))
    return counted.join(F.broadcast(total)).select("surface", "documents", P.round4(P.familiarity(F.col("documents"), F.col("total"))).alias("familiarity"))


@register(f"WITH {O.ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY surface, reading ORDER BY word_id) AS n FROM entries) SELECT surface, reading, word_id, cost FROM n WHERE n = 1")
def distinct_entries(spark, sf_dir):
    rows = L.entries_of(counts_of(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("surface", "reading").orderBy("word_id"))
    return rows.withColumn("n", first).where("n = 1").select("surface", "reading", "word_id", "cost")


@register(f"WITH {O.ENTRIES} SELECT word_id, surface, reading FROM entries WHERE pos[1] NOT IN ({', '.join(map(O.text, L.EXCLUDED_POS))}) AND regexp_matches(surface, '{P.SEARCHABLE}') AND regexp_matches(reading, '^[ァ-ヺー]+$')")
def filter_entries(spark, sf_dir):
    rows = L.entries_of(counts_of(spark, sf_dir))
    return rows.where(~F.get("pos", 0).isin(L.EXCLUDED_POS) & P.is_searchable(F.col("surface")) & P.is_pronounceable(F.col("reading"))).select("word_id", "surface", "reading")


@register(f"WITH {O.ENTRIES} SELECT word_id, surface, CASE WHEN surface = reading THEN 0.0::DOUBLE WHEN regexp_matches(surface, '{P.KANJI}') THEN 1.0 ELSE 0.5 END AS told, NOT regexp_matches(surface, '{P.UNREADABLE}') AS readable FROM entries")
def informativeness(spark, sf_dir):
    s, r = F.col("surface"), F.col("reading")
    return L.entries_of(counts_of(spark, sf_dir)).select("word_id", "surface", P.informativeness(s, r).cast("double").alias("told"), P.is_readable(s).alias("readable"))


@register(O.with_lexicon("SELECT category, count(*) AS words FROM lexicon GROUP BY category"))
def category_counts(spark, sf_dir):
    return X.category_counts(index_of(spark, sf_dir).lexicon)


@register(O.with_lexicon("SELECT mora_count, words, coalesce(sum(words) OVER (ORDER BY mora_count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shorter FROM (SELECT mora_count, count(*) AS words FROM lexicon GROUP BY mora_count)"))
def mora_histogram(spark, sf_dir):
    return X.mora_histogram(index_of(spark, sf_dir).lexicon)


@register(O.with_lexicon("SELECT count(*) AS words FROM lexicon WHERE mora_count BETWEEN 4 AND 6"))
def mora_range_size(spark, sf_dir):
    return X.mora_range(index_of(spark, sf_dir).lexicon, 4, 6).agg(F.count(F.lit(1)).alias("words"))


@register(O.with_lexicon("SELECT surface, reading, category FROM lexicon WHERE category IN ('person', 'place')"))
def filter_category(spark, sf_dir):
    return index_of(spark, sf_dir).lexicon.where(F.col("category").isin(L.parse_categories("person, place"))).select("surface", "reading", "category")


@register(O.with_lexicon("SELECT surface, reading, mora_count FROM lexicon WHERE mora_count BETWEEN 3 AND 4"))
def filter_mora_range(spark, sf_dir):
    return X.mora_range(index_of(spark, sf_dir).lexicon, 3, 4).select("surface", "reading", "mora_count")


# Phonology -----------------------------------------------------------------------------------------------------------


@register(f"WITH {O.TOKENS} SELECT token, {O.katakana(f'translate({O.spell(chr(116) + chr(111) + chr(107) + chr(101) + chr(110))}, {O.text(I.KATAKANA)}, {O.text(I.HIRAGANA)})')} AS kana FROM counts")
def katakana(spark, sf_dir):
    hiragana = F.translate(L.spell(F.col("token")), I.KATAKANA, I.HIRAGANA)
    return counts_of(spark, sf_dir).select("token", P.to_katakana(hiragana).alias("kana"))


def _spelled(query: str) -> str:
    return f"WITH {O.TOKENS}, r AS (SELECT token, {O.spell('token')} AS reading FROM counts), c AS (SELECT *, {O.codes('reading')} AS codes FROM r) {query}"


@register(_spelled(f"SELECT token, {O.joined(O.kana_list('reading'), '|')} AS moras, {O.mora_count('codes')} AS mora_count FROM c"))
def mora_split(spark, sf_dir):
    return readings_of(spark, sf_dir).select("token", F.array_join(P.mora_kana(F.col("reading")), "|").alias("moras"), P.mora_count(F.col("codes")).alias("mora_count"))


@register(_spelled(f"SELECT token, {O.phon('codes')} AS phonemes FROM c"))
def phonemes(spark, sf_dir):
    return readings_of(spark, sf_dir).select("token", P.phoneme_string(F.col("codes")).alias("phonemes"))


@register(_spelled(f"SELECT token, {O.skeleton('codes')} AS skeleton FROM c"))
def vowel_skeleton(spark, sf_dir):
    return readings_of(spark, sf_dir).select("token", P.vowel_skeleton(F.col("codes")).alias("skeleton"))


@register(_spelled(f"SELECT token, {O.ipa('codes')} AS ipa FROM c"))
def ipa(spark, sf_dir):
    return readings_of(spark, sf_dir).select("token", P.ipa(F.col("codes")).alias("ipa"))


@register(f"WITH {_NATION} SELECT id AS query_id, name AS text, reading, {O.phon('codes')} AS phonemes, {O.ipa('codes')} AS ipa, {O.mora_count('codes')} AS mora_count, {O.skeleton('codes')} AS skeleton FROM sounded_nations")
def pronounce(spark, sf_dir):
    c = F.col("codes")
    return nations(spark, sf_dir).select("query_id", "text", "reading", P.phoneme_string(c).alias("phonemes"), P.ipa(c).alias("ipa"), "mora_count", P.vowel_skeleton(c).alias("skeleton"))


# Distances -----------------------------------------------------------------------------------------------------------


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nations(spark, sf_dir).select(F.col("query_id").alias("id"), "reading", "codes")
    return rows.toDF("a", "reading_a", "codes_a").join(rows.toDF("b", "reading_b", "codes_b"), F.col("a") < F.col("b"))


_PAIRS = f"{_NATION}, pairs AS (SELECT x.id AS a, y.id AS b, x.codes AS codes_a, y.codes AS codes_b, {O.skeleton('x.codes')} AS skel_a, {O.skeleton('y.codes')} AS skel_b FROM sounded_nations x JOIN sounded_nations y ON x.id < y.id), {O.COSTS}"


@register(f"WITH {_PAIRS} SELECT a, b, {O.four(O.edit_distance('codes_a', 'codes_b'))} AS distance FROM pairs, costs")
def edit_distance(spark, sf_dir):
    return nation_pairs(spark, sf_dir).select("a", "b", P.round4(D.edit_distance(F.col("codes_a"), F.col("codes_b"))).alias("distance"))


@register(f"WITH {_PAIRS} SELECT a, b, {O.four(O.edit_distance('codes_a', 'codes_b'))} AS distance FROM pairs, costs")
def edit_distance_native(spark, sf_dir):
    return nation_pairs(spark, sf_dir).select("a", "b", P.round4(D.edit_distance_native(F.col("codes_a"), F.col("codes_b"))).alias("distance"))


@register(f"WITH {_PAIRS} SELECT a, b, {O.four(O.similarity(O.edit_distance('codes_a', 'codes_b'), 'codes_a', 'codes_b'))} AS phonetic, {O.four(O.similarity(O.edit_distance('skel_a', 'skel_b'), 'skel_a', 'skel_b'))} AS vowel, {O.four(O.mora_similarity(O.mora_count('codes_a'), O.mora_count('codes_b')))} AS mora FROM pairs, costs")
def similarities(spark, sf_dir):
    rows = nation_pairs(spark, sf_dir).withColumns({"skel_a": P.vowel_skeleton(F.col("codes_a")), "skel_b": P.vowel_skeleton(F.col("codes_b"))})
    sim = lambda x, y: P.round4(D.similarity(D.edit_distance(F.col(x), F.col(y)), F.length(x), F.length(y)))
    moras = D.mora_similarity(P.mora_count(F.col("codes_a")), P.mora_count(F.col("codes_b")))
    return rows.select("a", "b", sim("codes_a", "codes_b").alias("phonetic"), sim("skel_a", "skel_b").alias("vowel"), P.round4(moras).alias("mora"))


def _cosine(name: str, kind) -> str:
    return f"{kind(name, 'both_codes')}, {name}_dot AS (SELECT p.a, p.b, sum(x.value * y.value) AS v FROM pairs p JOIN {name} x ON x.codes = p.codes_a JOIN {name} y ON y.codes = p.codes_b AND y.dim = x.dim GROUP BY p.a, p.b)"


@register(
    f"WITH {_PAIRS}, {O.FEATURES}, both_codes AS (SELECT codes FROM sounded_nations), {_cosine('vp', O.phonetic_vectors)}, {_cosine('vc', O.coda_vectors)} "
    f"SELECT a, b, {O.four(O.edit_distance('codes_a', 'codes_b'))} AS distance, {O.four(O.similarity(O.edit_distance('codes_a', 'codes_b'), 'codes_a', 'codes_b'))} AS similarity, {O.four('coalesce(p.v, 0)')} AS phonetic, {O.four('coalesce(c.v, 0)')} AS coda, {O.four(O.similarity(O.edit_distance('skel_a', 'skel_b'), 'skel_a', 'skel_b'))} AS vowel "
    "FROM pairs LEFT JOIN vp_dot p USING (a, b) LEFT JOIN vc_dot c USING (a, b), costs"
)
def compare_pairs(spark, sf_dir):
    return S.compare(nation_pairs(spark, sf_dir).select("a", "b", "reading_a", "reading_b")).select("a", "b", "distance", "similarity", "phonetic", "coda", "vowel")


@register(
    f"WITH {_PAIRS}, {O.FEATURES}, both_codes AS (SELECT codes FROM sounded_nations), {_cosine('vk', O.consonant_vectors)} "
    f"SELECT a, b, {O.four('coalesce(k.v, 0)')} AS consonant, {O.four(O.rhythm_similarity('codes_a', 'codes_b'))} AS rhythm FROM pairs LEFT JOIN vk_dot k USING (a, b)"
)
def compare_spaces(spark, sf_dir):
    return S.compare(nation_pairs(spark, sf_dir).select("a", "b", "reading_a", "reading_b")).select("a", "b", "consonant", "rhythm")


@register()
def align_pairs(spark, sf_dir):
    rows = nation_pairs(spark, sf_dir).withColumn("pairs", D.alignment(P.symbols(F.col("codes_a")), P.symbols(F.col("codes_b"))))
    return rows.select("a", "b", F.posexplode("pairs").alias("place", "p")).select("a", "b", "place", F.col("p.a").alias("left"), F.col("p.b").alias("right"), P.round4(F.col("p.distance")).alias("distance"), "p.op")


@register(O.PHONEME_DISTANCES)
def phoneme_distances(spark, sf_dir):
    cost = F.array(*[F.array(*map(F.lit, row)) for row in D.SUBSTITUTE[: D.UNKNOWN, : D.UNKNOWN].tolist()])
    names = F.array(*map(F.lit, I.SYMBOLS))
    one = spark.range(len(I.SYMBOLS)).select(F.col("id").alias("i"))
    both = one.join(one.select(F.col("i").alias("j")))
    return both.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), P.round4(cost[F.col("i")][F.col("j")]).alias("distance"))


_KIND = {s: "consonant" for s in I.CONSONANTS} | {s: "vowel" for s in I.VOWELS} | {s: "special" for s in I.SPECIALS}


@register(O.PHONEME_FEATURES)
def phoneme_features(spark, sf_dir):
    return spark.createDataFrame([(s, k, I.IPA[s]) for s, k in _KIND.items()], "symbol string, kind string, ipa string")


_STEM = f"asked AS (SELECT n_nationkey::BIGINT AS query_id, {O.codes(O.spell('lower(left(n_name, 3))'))} AS query_codes FROM nation)"


@register(O.with_lexicon("SELECT a.query_id, s.phon, " + O.four(O.containment("a.query_codes", "s.codes")) + f" AS ratio FROM asked a JOIN s ON length(a.query_codes) > 0 AND regexp_matches(s.codes, {O.pattern('a.query_codes')})", f", {_STEM}, s AS (SELECT DISTINCT phon, codes FROM lexicon)"))
def containment(spark, sf_dir):
    """Sounds that hold the beginning of a nation's name."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), P.codes(L.spell(F.lower(F.substring("n_name", 1, 3)))).alias("query_codes"))
    sounds = index_of(spark, sf_dir).groups.select("phon", "codes")
    holds = F.regexp_like("codes", D.containment_pattern_column(F.col("query_codes"))) & (F.length("query_codes") > 0)
    return sounds.join(F.broadcast(asked), holds).select("query_id", "phon", P.round4(D.containment(F.col("query_codes"), F.col("codes"))).alias("ratio"))  # a row a nation


_HOLDS = f", {O.NATIONS}, s AS (SELECT DISTINCT phon, codes FROM lexicon)"


@register(O.with_lexicon(f"SELECT a.query_id, s.phon, {O.four(O.containment('a.query_codes', 's.codes'))} AS ratio FROM asked a JOIN s ON length(a.query_codes) > 0 AND regexp_matches(s.codes, {O.pattern('a.query_codes')})", _HOLDS))
def containment_names(spark, sf_dir):
    """Sounds that hold the whole of a nation's name."""
    asked = nations(spark, sf_dir).select("query_id", F.col("codes").alias("query_codes"))
    sounds = index_of(spark, sf_dir).groups.select("phon", "codes")
    holds = F.regexp_like("codes", D.containment_pattern_column(F.col("query_codes"))) & (F.length("query_codes") > 0)
    return sounds.join(staging.small(asked), holds).select("query_id", "phon", P.round4(D.containment(F.col("query_codes"), F.col("codes"))).alias("ratio"))


# Groups and vectors --------------------------------------------------------------------------------------------------


@register(O.with_lexicon("SELECT mora_count, phon, count(*) AS words FROM lexicon GROUP BY mora_count, phon"))
def sound_groups(spark, sf_dir):
    return X.distinct_sounds(index_of(spark, sf_dir).lexicon).select("mora_count", "phon", "words")


@register(O.with_lexicon("SELECT l.surface, l.reading, g.words FROM lexicon l JOIN (SELECT phon, count(*) AS words FROM lexicon GROUP BY phon HAVING count(*) > 1) g USING (phon)"))
def homophones(spark, sf_dir):
    words = index_of(spark, sf_dir).lexicon
    several = X.distinct_sounds(words).where("words > 1")
    return words.join(several.select("mora_count", "phon", "words"), ["mora_count", "phon"]).select("surface", "reading", "words")


@register(O.with_lexicon(f"SELECT reading, surface FROM (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY CASE WHEN surface = reading THEN 0.0 WHEN regexp_matches(surface, '{P.KANJI}') THEN 1.0 ELSE 0.5 END DESC, familiarity DESC, surface DESC) AS n FROM lexicon) WHERE n = 1"))
def dedupe_by_reading(spark, sf_dir):
    rows = index_of(spark, sf_dir).lexicon
    order = Window.partitionBy("reading").orderBy(P.informativeness(F.col("surface"), F.col("reading")).desc(), F.desc("familiarity"), F.desc("surface"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("reading", "surface")


_VECTORS = "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings), s AS (SELECT max(abs(x)) / 127 AS s FROM v), q AS (SELECT vec_id, i, greatest(-127, least(127, round_even(x / (SELECT s FROM s), 0)::BIGINT)) AS q FROM v)"


def _quantized_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", E.quantize(F.col("v"), F.lit(E.peak(rows, "v")["v"])).alias("q"))


@register(f"WITH {_VECTORS} SELECT vec_id, sum(q)::BIGINT AS total, sum(abs(q))::BIGINT AS mass, max(q)::BIGINT AS top FROM q GROUP BY vec_id")
def quantize(spark, sf_dir):
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return _quantized_embeddings(spark, sf_dir).select("vec_id", total("q").alias("total"), total(F.transform("q", lambda x: F.abs(x.cast("long")))).alias("mass"), F.array_max("q").cast("long").alias("top"))


@register(f"WITH {_VECTORS}, a AS (SELECT i, q FROM q WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT q.vec_id, sum(q.q * a.q)::BIGINT AS dot FROM q JOIN a USING (i) GROUP BY q.vec_id")
def int8_dot(spark, sf_dir):
    rows = _quantized_embeddings(spark, sf_dir)
    first = rows.orderBy("vec_id").limit(1).select(F.col("q").alias("asked"))
    return rows.join(F.broadcast(first)).select("vec_id", E.dot(F.col("q"), F.col("asked")).alias("dot"))  # one row


@register(f"WITH {_VECTORS}, a AS (SELECT i, q FROM q WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT q.vec_id, sum(q.q * a.q)::BIGINT AS dot FROM q JOIN a USING (i) GROUP BY q.vec_id ORDER BY dot DESC, vec_id LIMIT 20")
def int8_topk(spark, sf_dir):
    return int8_dot(spark, sf_dir).orderBy(F.desc("dot"), "vec_id").limit(20)


@register(f"WITH {_VECTORS} SELECT a.vec_id AS query_id, q.vec_id, sum(q.q * a.q)::BIGINT AS dot FROM q JOIN q a USING (i) WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, q.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dot DESC, q.vec_id) <= 20")
def int8_search(spark, sf_dir):
    """The 20 nearest rows of every row whose vec_id is divisible by 100, in blocks of queries."""
    return S.nearest_vectors(_quantized_embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0, 20)


_SOUND_DOT = f", {O.REGIONS}, {O.SOUNDS}"


@register(O.with_lexicon("SELECT a.query_id, s.mora_count, s.phon, p.dot FROM asked a JOIN dots_p p ON p.query_codes = a.query_codes JOIN sounds s ON s.codes = p.codes AND abs(s.mora_count - a.query_moras) <= 3 QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY p.dot DESC, s.mora_count, s.phon) <= 50", _SOUND_DOT))
def topk_sounds(spark, sf_dir):
    return S.candidate_sounds(index_of(spark, sf_dir), regions(spark, sf_dir), 50, contained=False).select("query_id", "mora_count", "phon", "dot")


@register(O.with_lexicon("SELECT t.query_id, t.phon, l.surface, l.reading FROM (SELECT a.query_id, s.mora_count, s.phon, p.dot FROM asked a JOIN dots_p p ON p.query_codes = a.query_codes JOIN sounds s ON s.codes = p.codes AND abs(s.mora_count - a.query_moras) <= 3 QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY p.dot DESC, s.mora_count, s.phon) <= 50) t JOIN lexicon l USING (mora_count, phon)", _SOUND_DOT))
def expand_sounds(spark, sf_dir):
    index = index_of(spark, sf_dir)
    top = S.candidate_sounds(index, regions(spark, sf_dir), 50, contained=False).select("query_id", "mora_count", "phon")
    return top.join(index.lexicon, ["mora_count", "phon"]).select("query_id", "phon", "surface", "reading")


@register(O.with_lexicon("SELECT a.query_id, s.mora_count, s.phon, s.ratio, s.near FROM (SELECT a.query_id, s.mora_count, s.phon, " + O.four(O.containment("a.query_codes", "s.codes")) + " AS ratio, row_number() OVER (PARTITION BY a.query_id ORDER BY CASE WHEN abs(s.mora_count - a.query_moras) <= 3 THEN 0 ELSE 1 END, p.dot DESC, s.mora_count, s.phon) <= 50 AND abs(s.mora_count - a.query_moras) <= 3 AS near FROM asked a CROSS JOIN sounds s JOIN dots_p p ON p.codes = s.codes AND p.query_codes = a.query_codes) s JOIN asked a USING (query_id) WHERE s.near OR s.ratio > 0", _SOUND_DOT))
def merge_containment(spark, sf_dir):
    found = S.candidate_sounds(index_of(spark, sf_dir), regions(spark, sf_dir), 50)
    return found.select("query_id", "mora_count", "phon", P.round4(F.col("ratio")).alias("ratio"), F.col("dot").isNotNull().alias("near"))


@register()
def sound_vectors(spark, sf_dir):
    return X.sound_vectors(index_of(spark, sf_dir).lexicon).select("mora_count", "phon", F.transform("raw_phonetic", P.round4).alias("phonetic"), F.transform("raw_coda", P.round4).alias("coda"))


@register(O.with_lexicon("SELECT name, value FROM (SELECT 'count' AS name, count(*)::VARCHAR AS value FROM lexicon UNION ALL SELECT 'version', '1' UNION ALL SELECT 'category.' || category, count(*)::VARCHAR FROM lexicon GROUP BY category UNION ALL SELECT 'dim.phonetic', '72' UNION ALL SELECT 'dim.coda', '48')"))
def index_info(spark, sf_dir):
    return X.info(index_of(spark, sf_dir))


# Search --------------------------------------------------------------------------------------------------------------

_SHOWN = ["query_id", "rank", "word", "reading", "score", "phonetic_similarity", "embedding_similarity", "coda_similarity", "vowel_similarity", "mora_similarity", "containment", "mora_count", "category", "pos", "familiarity"]


@register(O.search("pun", 10, S.CANDIDATES, S.MORA_GAP))
def search_pun(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), regions(spark, sf_dir)).select(*_SHOWN)


@register(O.search("rhyme", 10, S.CANDIDATES, S.MORA_GAP))
def search_rhyme(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), regions(spark, sf_dir), preset="rhyme").select(*_SHOWN)


@register(O.search("mishearing", 10, S.CANDIDATES, S.MORA_GAP))
def search_mishearing(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), regions(spark, sf_dir), preset="mishearing").select(*_SHOWN)


@register(O.search("pun", 20, S.CANDIDATES, S.MORA_GAP, 5, 5))
def search_range(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), regions(spark, sf_dir), limit=20, min_mora=5, max_mora=5).select(*_SHOWN)


@register(O.search("pun", 10, S.CANDIDATES, S.MORA_GAP, names=O.NATIONS))
def search_nations(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), nations(spark, sf_dir)).select(*_SHOWN)


@register(O.search("pun", 0, S.CANDIDATES, S.MORA_GAP, floor=0.7))
def search_floor(spark, sf_dir):
    return S.search_with_floor(index_of(spark, sf_dir), regions(spark, sf_dir)).select(*_SHOWN, "below_floor")


@register()
def read_texts(spark, sf_dir):
    """Every surface of the lexicon, before the last surface of as many moras."""
    index = index_of(spark, sf_dir)
    ends = index.lexicon.groupBy("mora_count").agg(F.max("surface").alias("b"))  # a row a length
    words = index.lexicon.select("mora_count", "surface").distinct().join(F.broadcast(ends), "mora_count")
    texts = words.select(F.xxhash64("surface", "mora_count").alias("text_id"), F.concat("surface", "b").alias("text"))
    return S.read_texts(texts, index.lexicon)


# Phrases -------------------------------------------------------------------------------------------------------------


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select(F.col("query_id").alias("phrase_id"), "reading")


_SPANS = f"WITH {O.REGIONS}, m AS (SELECT query_id AS phrase_id, {O.kana_list('query_reading')} AS kana FROM asked), s AS (SELECT *, unnest(generate_series(0, len(kana) - 1)) AS start FROM m), e AS (SELECT *, unnest(generate_series(start + 1, least(len(kana), start + 4))) AS \"end\" FROM s), spans AS (SELECT phrase_id, start::INTEGER AS start, \"end\"::INTEGER AS \"end\", array_to_string(kana[start + 1:\"end\"], '') AS source_reading FROM e), sounded_spans AS (SELECT *, {O.codes('source_reading')} AS span_codes FROM spans)"


@register(f'{_SPANS} SELECT phrase_id, start, "end", source_reading, span_codes FROM sounded_spans')
def phrase_spans(spark, sf_dir):
    return H.spans(phrases(spark, sf_dir))


_PARTICLES = f"{O.PARTICLES}, sounded_particles AS (SELECT *, {O.codes('reading')} AS codes FROM particles), {O.COSTS}, sounds_of_spans AS (SELECT DISTINCT span_codes FROM sounded_spans)"
_NEAR = O.similarity(O.edit_distance("s.span_codes", "p.codes"), "s.span_codes", "p.codes")


@register(f"{_SPANS}, {_PARTICLES}, n AS (SELECT s.span_codes, p.surface, p.reading, {_NEAR} AS similarity FROM sounds_of_spans s JOIN sounded_particles p ON {O.mora_count('s.span_codes')} = {O.mora_count('p.codes')}, costs) SELECT span_codes, surface, reading, {O.four('similarity')} AS similarity, {O.four('(0.72 * similarity + 0.16 + 0.08 * 0.5) * 0.98')} AS weight FROM n WHERE similarity >= {H.MIN_CHUNK}")
def particle_options(spark, sf_dir):
    sounds = H.spans(phrases(spark, sf_dir)).select("span_codes", P.mora_count(F.col("span_codes")).alias("mora_count")).distinct()
    return H.particle_options(sounds).select("span_codes", "surface", "reading", P.round4(F.col("similarity")).alias("similarity"), P.round4(F.col("weight")).alias("weight"))


_WORDS_NEAR = O.similarity(O.edit_distance("s.span_codes", "g.codes"), "s.span_codes", "g.codes")
_OPTIONS = f""", {_SPANS.removeprefix('WITH ')}, {_PARTICLES},
usual AS (SELECT * FROM lexicon WHERE category IN ({', '.join(map(O.text, L.DEFAULT_CATEGORIES))})),
heard AS (SELECT DISTINCT mora_count, codes, phon FROM usual),
near AS (SELECT * FROM (SELECT s.span_codes, g.mora_count, g.phon, {_WORDS_NEAR} AS similarity FROM sounds_of_spans s JOIN heard g ON {O.mora_count('s.span_codes')} = g.mora_count, costs) WHERE similarity >= {H.MIN_CHUNK}),
part AS (SELECT n.span_codes, w.surface, w.reading, n.similarity, {H.SIMILARITY_WEIGHT}::DOUBLE * n.similarity + {H.FAMILIARITY_WEIGHT}::DOUBLE * w.familiarity::DOUBLE AS part FROM near n JOIN usual w USING (mora_count, phon)),
first_some AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY span_codes ORDER BY part DESC, reading, surface) <= {4 * H.CHUNK_CANDIDATES}),
told AS (
  SELECT *, part + {H.INFORMATION_WEIGHT}::DOUBLE * (CASE WHEN surface = reading THEN 0.0::DOUBLE WHEN regexp_matches(surface, '{P.KANJI}') THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS weight
  FROM first_some WHERE NOT regexp_matches(surface, '{P.UNREADABLE}')),
by_reading AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY span_codes, reading ORDER BY weight DESC, part DESC, surface) = 1),
function_words AS (SELECT * FROM (SELECT s.span_codes, p.surface, p.reading, {_NEAR} AS similarity FROM sounds_of_spans s JOIN sounded_particles p ON {O.mora_count('s.span_codes')} = {O.mora_count('p.codes')}, costs) WHERE similarity >= {H.MIN_CHUNK}),
every AS (
  SELECT span_codes, surface, reading, similarity, weight, false AS is_particle FROM by_reading
  UNION ALL SELECT span_codes, surface, reading, similarity, ({H.SIMILARITY_WEIGHT}::DOUBLE * similarity + {H.FAMILIARITY_WEIGHT}::DOUBLE + {H.INFORMATION_WEIGHT * 0.5}::DOUBLE) * {H.PARTICLE_FACTOR}::DOUBLE, true FROM function_words),
ranked AS (SELECT *, row_number() OVER (PARTITION BY span_codes ORDER BY weight DESC, is_particle, similarity DESC, reading, surface)::INTEGER AS place FROM every)"""


@register(
    O.with_lexicon(f'SELECT phrase_id, start, "end", place, surface, reading, {O.four("similarity")} AS similarity, {O.four("weight")} AS weight, is_particle FROM sounded_spans JOIN ranked USING (span_codes) WHERE place <= {H.CHUNK_CANDIDATES}', _OPTIONS)
)
def chunk_options(spark, sf_dir):
    found = H.options(H.spans(phrases(spark, sf_dir)), index_of(spark, sf_dir))
    return found.select("phrase_id", "start", "end", "place", "surface", "reading", P.round4(F.col("similarity")).alias("similarity"), P.round4(F.col("weight")).alias("weight"), "is_particle")


@register()
def compose_phrases(spark, sf_dir):
    return H.compose(phrases(spark, sf_dir), index_of(spark, sf_dir))


@register()
def lattice_nodes(spark, sf_dir):
    return H.lattice(phrases(spark, sf_dir), index_of(spark, sf_dir))[0]


@register()
def lattice_edges(spark, sf_dir):
    return H.lattice(phrases(spark, sf_dir), index_of(spark, sf_dir))[1]
