"""SQL for the registered queries, made from the same fixed values as the engine."""

from __future__ import annotations

from ..functions import distance as D
from ..functions import embedding as E
from ..functions import inventory as I
from ..functions import phonology as P
from ..functions.scoring import PRESETS
from ..sources import lexicon as L
from ..sources.vocabulary import PARTICLES as FUNCTION_WORDS


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapping(found: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in found.items()) + "}"


def katakana(x: str) -> str:
    return f"translate({x}, {text(I.HIRAGANA)}, {text(I.KATAKANA)})"


def kana_list(reading: str) -> str:
    return f"regexp_extract_all({katakana(reading)}, {text(f'({I.MORA_PATTERN})')}, 1)"


def joined(parts: str, sep: str = "") -> str:
    return f"coalesce(array_to_string({parts}, {text(sep)}), '')"


def codes(reading: str) -> str:
    return joined(f"list_transform({kana_list(reading)}, lambda k: {mapping(I.KANA_CODES)}[k])")


def chars(code: str) -> str:
    return f"list_filter(string_split({code}, ''), lambda c: c <> '')"


def symbols(code: str) -> str:
    return f"list_transform({chars(code)}, lambda c: {mapping(I.SYMBOL)}[c])"


def phon(code: str) -> str:
    return joined(symbols(code), " ")


def mora_count(code: str) -> str:
    return f"length(regexp_replace({code}, '[{I.CONSONANT_CODES}]', '', 'g'))::INTEGER"


def skeleton(code: str) -> str:
    kept = ", ".join(text(c) for c in I.VOWEL_CODES + "QN")
    return f"list_reduce({chars(code)}, lambda s, c: CASE WHEN c IN ({kept}) THEN s || c WHEN c = 'R' THEN s || right(s, 1) ELSE s END, '')"


def ipa(code: str) -> str:
    table = mapping({I.CODE[s]: v for s, v in I.IPA.items()})
    firsts = mapping({I.CODE[s]: I.IPA[s][0] for s in I.CONSONANTS})
    cs = chars(code)
    consonants = ", ".join(map(text, I.CONSONANT_CODES))
    return joined(f"list_transform({cs}, lambda c, i: CASE WHEN c = 'Q' AND coalesce({cs}[i + 1], '') IN ({consonants}) THEN {firsts}[{cs}[i + 1]] ELSE {table}[c] END)")


def spell(word: str) -> str:
    for pair, kana in L.LETTER_PAIRS.items():
        word = f"replace({word}, {text(pair)}, {text(kana)})"
    return f"translate({word}, {text(L.LETTERS)}, {text(L.LETTER_KANA)})"


def familiarity(documents: str, total: str) -> str:
    return f"(CASE WHEN {documents} IS NULL OR {documents} <= 0 THEN 0.25::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, log10({documents}::DOUBLE / {total} * 1e6::DOUBLE + 1) / 4.5::DOUBLE)) END)"


def four(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5::DOUBLE) / 10000"


def three(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5::DOUBLE) / 1000"


TOKENS = """
each_word AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS token FROM documents),
counts AS (SELECT token, count(*) AS documents FROM each_word WHERE length(token) >= 2 GROUP BY token)"""

_N = "(length(token) + ascii(token))"
ENTRIES = f"""{TOKENS},
spelled AS (SELECT token, documents, {spell('token')} AS reading FROM counts),
entries AS (
  SELECT token AS word_id, reading, documents, regexp_replace(token, 's$', '') AS normalized, (length(token) * 1000)::INTEGER AS cost,
    CASE length(token) % 4 WHEN 0 THEN reading WHEN 1 THEN translate(reading, {text(I.KATAKANA)}, {text(I.HIRAGANA)}) WHEN 2 THEN '語' || translate(reading, {text(I.KATAKANA)}, {text(I.HIRAGANA)}) ELSE '語' || token END AS surface,
    CASE WHEN {_N} % 11 = 0 THEN ['助詞'] WHEN {_N} % 11 = 1 THEN ['感動詞'] WHEN {_N} % 5 = 1 THEN ['名詞', '固有名詞', '一般'] WHEN {_N} % 5 = 2 THEN ['名詞', '固有名詞', '人名'] WHEN {_N} % 5 = 3 THEN ['名詞', '固有名詞', '地名'] ELSE ['名詞', '普通名詞', '一般'] END AS pos
  FROM spelled)"""

LEXICON = f"""{ENTRIES},
frequencies AS (SELECT surface, sum(documents)::BIGINT AS documents FROM entries GROUP BY surface),
corpus AS (SELECT count(DISTINCT doc_id) AS total FROM documents),
sounded AS (SELECT *, {codes('reading')} AS codes FROM entries WHERE pos[1] NOT IN ({', '.join(map(text, L.EXCLUDED_POS))}) AND regexp_matches(surface, '{P.SEARCHABLE}') AND regexp_matches(reading, '^[ァ-ヺー]+$')),
counted AS (SELECT *, {mora_count('codes')} AS mora_count, row_number() OVER (PARTITION BY surface, reading ORDER BY word_id) AS n FROM sounded),
lexicon AS MATERIALIZED (
  SELECT c.surface, c.reading, c.normalized, coalesce(c.pos[2], c.pos[1], '') AS pos,
    CASE WHEN len(c.pos) < 2 THEN 'other' WHEN c.pos[2] <> '固有名詞' THEN 'common' WHEN c.pos[3] = '人名' THEN 'person' WHEN c.pos[3] = '地名' THEN 'place' ELSE 'product' END AS category,
    c.cost, {familiarity('f.documents', 'corpus.total')}::FLOAT AS familiarity, c.mora_count, {phon('c.codes')} AS phon, c.codes
  FROM counted c LEFT JOIN frequencies f USING (surface), corpus WHERE c.n = 1 AND c.mora_count BETWEEN {L.MIN_MORA} AND {L.MAX_MORA})"""


def with_lexicon(query: str, more: str = "") -> str:
    return f"WITH {LEXICON}{more} {query}"


# Edit distance ------------------------------------------------------------------------------------------------------

COSTS = f"costs AS (SELECT [{', '.join(f'{x!r}::DOUBLE' for row in D.SUBSTITUTE.tolist() for x in row)}] AS sub, [{', '.join(f'{x!r}::DOUBLE' for x in D.INDELS.tolist())}] AS gap)"
_WIDE = len(D.INDELS)


def ids(code: str) -> str:
    """Each phoneme's number (from 1) as a list of one double, as folds want one type."""
    return f"list_transform({chars(code)}, lambda c: [instr({text(I.CODES)}, c)::DOUBLE])"


def edit_distance(a: str, b: str) -> str:
    """For columns a and b of codes beside a row of COSTS."""
    first = f"list_reduce({ids(b)}, lambda r, y: list_append(r, r[-1] + costs.gap[y[1]::INTEGER]), [0.0::DOUBLE])"
    cell = f"least(row[len(acc)] + costs.sub[((x[1] - 1) * {_WIDE} + y[1])::INTEGER], row[len(acc) + 1] + costs.gap[x[1]::INTEGER], acc[-1] + costs.gap[y[1]::INTEGER])"
    line = f"list_reduce({ids(b)}, lambda acc, y: list_append(acc, {cell}), [row[1] + costs.gap[x[1]::INTEGER]])"
    return f"(list_reduce({ids(a)}, lambda row, x: {line}, {first}))[-1]"


def similarity(distance: str, a: str, b: str) -> str:
    top = f"(least(length({a}), length({b})) * {D.WORST!r}::DOUBLE + abs(length({a}) - length({b})) * {D.INDEL!r}::DOUBLE)"
    return f"(CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0::DOUBLE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {distance} / {top}) END)"


def pattern(code: str) -> str:
    return joined(chars(code), f"[{I.SPECIAL_CODES}]*")


def containment(query: str, code: str) -> str:
    return f"(CASE WHEN length({query}) > 0 AND regexp_matches({code}, {pattern(query)}) THEN length({query})::DOUBLE / length({code}) ELSE 0.0::DOUBLE END)"


def mora_similarity(a: str, b: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs({a} - {b})::DOUBLE / greatest({a}, {b}, 1)))"


# Vectors ------------------------------------------------------------------------------------------------------------

FEATURES = "features AS (SELECT * FROM (VALUES " + ", ".join(f"('{I.CODES[i]}', {d}, {v!r}::DOUBLE)" for i in range(len(I.SYMBOLS)) for d, v in enumerate(E.FEATURES[i].tolist()) if v) + ") AS t(code, dim, value))"


def phonetic_vectors(name: str, source: str) -> str:
    """CTEs name(codes, dim, value): the unit vectors of the distinct codes of source."""
    return f"""
{name}_at AS (SELECT codes, length(codes) AS n, unnest(generate_series(0, length(codes) - 1)) AS i FROM (SELECT DISTINCT codes FROM {source})),
{name}_bins AS (SELECT codes, n, i, unnest(CASE WHEN n = 1 THEN [0, 1, 2] WHEN i < n // 2 THEN [0, 1] ELSE [0, 2] END) AS bin FROM {name}_at),
{name}_raw AS (SELECT b.codes, b.bin * {E.BLOCK} + f.dim AS dim, sum(f.value) / any_value(CASE WHEN b.bin = 0 OR b.n = 1 THEN b.n WHEN b.bin = 1 THEN b.n // 2 ELSE b.n - b.n // 2 END) AS value
  FROM {name}_bins b JOIN features f ON f.code = substr(b.codes, b.i + 1, 1) GROUP BY b.codes, b.bin * {E.BLOCK} + f.dim),
{name} AS (SELECT codes, dim, value / sqrt(sum(value * value) OVER (PARTITION BY codes)) AS value FROM {name}_raw)"""


def coda_vectors(name: str, source: str) -> str:
    """The same for the last two moras."""
    mora = f"[{I.CONSONANT_CODES}]?[{I.VOWEL_CODES}]|[{I.SPECIAL_CODES}]"
    return f"""
{name}_moras AS (SELECT codes, regexp_extract_all(codes, '({mora})', 1) AS m FROM (SELECT DISTINCT codes FROM {source})),
{name}_tail AS (SELECT codes, 0 AS slot, m[-2] AS mora FROM {name}_moras WHERE len(m) > 1 UNION ALL SELECT codes, 1, m[-1] FROM {name}_moras WHERE len(m) > 0),
{name}_at AS (SELECT codes, slot, length(mora) AS n, unnest(string_split(mora, '')) AS code FROM {name}_tail),
{name}_raw AS (SELECT a.codes, a.slot * {E.BLOCK} + f.dim AS dim, sum(f.value) / any_value(a.n) AS value FROM {name}_at a JOIN features f USING (code) GROUP BY a.codes, a.slot * {E.BLOCK} + f.dim),
{name} AS (SELECT codes, dim, value / sqrt(sum(value * value) OVER (PARTITION BY codes)) AS value FROM {name}_raw)"""


def quantized(name: str, source: str, scale: str) -> str:
    return f"{name} AS (SELECT codes, dim, greatest(-127, least(127, round_even(value / (SELECT s FROM {scale}), 0)::BIGINT)) AS q FROM {source})"


def scale_of(name: str, source: str) -> str:
    return f"{name} AS (SELECT CASE WHEN max(abs(value)) > 0 THEN max(abs(value)) / 127 ELSE 1 END AS s FROM {source})"


# Queries for search: the regions' names, spelled -------------------------------------------------------------------

def asked(table: str, key: str, name: str) -> str:
    """CTEs with the names of a table, spelled, as queries."""
    return f"""
asked_raw AS (SELECT {key}::BIGINT AS query_id, {name} AS query_text, {spell(f"regexp_replace(lower({name}), '[^a-z]', '', 'g')")} AS query_reading FROM {table}),
asked_codes AS (SELECT *, {codes('query_reading')} AS query_codes FROM asked_raw),
asked AS (SELECT *, {mora_count('query_codes')} AS query_moras, {skeleton('query_codes')} AS query_skeleton FROM asked_codes)"""


REGIONS, NATIONS = asked("region", "r_regionkey", "r_name"), asked("nation", "n_nationkey", "n_name")

SOUNDS = f"""
sounds AS (SELECT DISTINCT mora_count, phon, codes, {skeleton('codes')} AS skeleton FROM lexicon),
{FEATURES}, {COSTS}, asked_sound AS (SELECT DISTINCT query_codes AS codes FROM asked),
{phonetic_vectors('vp', 'sounds')}, {coda_vectors('vc', 'sounds')}, {scale_of('sp', 'vp')}, {scale_of('sc', 'vc')},
{quantized('qp', 'vp', 'sp')}, {quantized('qc', 'vc', 'sc')},
{phonetic_vectors('ap', 'asked_sound')}, {coda_vectors('ac', 'asked_sound')}, {quantized('aqp', 'ap', 'sp')}, {quantized('aqc', 'ac', 'sc')},
dots_p AS (SELECT g.codes, a.codes AS query_codes, sum(g.q * a.q)::BIGINT AS dot FROM qp g JOIN aqp a USING (dim) GROUP BY g.codes, a.codes),
dots_c AS (SELECT g.codes, a.codes AS query_codes, sum(g.q * a.q)::BIGINT AS dot FROM qc g JOIN aqc a USING (dim) GROUP BY g.codes, a.codes)"""


def search(preset: str, limit: int, candidates: int, gap: int, least: int | None = None, most: int | None = None, names: str = REGIONS, floor: float | None = None) -> str:
    """limit 0 is for a search with a floor: all rows above it, or 20 where there are none."""
    w = PRESETS[preset].normalized()
    ranged = least is not None or most is not None
    holds = w.containment > 0
    ratio = containment("a.query_codes", "s.codes") if holds else "0.0::DOUBLE"
    bounds = " AND ".join([f"mora_count >= {least}"] * (least is not None) + [f"mora_count <= {most}"] * (most is not None)) or "true"
    near = f"""
pairs AS (SELECT a.query_id, a.query_codes, s.mora_count, s.phon, s.codes, s.skeleton, {ratio} AS ratio, coalesce(p.dot, 0) AS dot, coalesce(c.dot, 0) AS coda_dot, {bounds if ranged else f'abs(s.mora_count - a.query_moras) <= {gap}'} AS near
  FROM asked a CROSS JOIN sounds s LEFT JOIN dots_p p ON p.codes = s.codes AND p.query_codes = a.query_codes LEFT JOIN dots_c c ON c.codes = s.codes AND c.query_codes = a.query_codes WHERE length(a.query_codes) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, mora_count, phon) AS r FROM pairs WHERE near),
found AS MATERIALIZED (SELECT query_id, mora_count, phon, codes, skeleton, dot::DOUBLE AS dot, ratio, coda_dot FROM top WHERE {'true' if ranged else f'r <= {candidates}'}
  {'' if ranged else f'UNION ALL SELECT query_id, mora_count, phon, codes, skeleton, 0.0, ratio, coda_dot FROM pairs p WHERE ratio > 0 AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = p.query_id AND t.phon = p.phon AND t.r <= {candidates})'})"""
    phonetic = similarity(edit_distance("a.query_codes", "f.codes"), "a.query_codes", "f.codes")
    score = "0.0::DOUBLE + " + " + ".join(f"{getattr(w, n)!r}::DOUBLE * c_{n}" for n in ("phonetic", "embedding", "mora", "coda", "vowel", "familiarity", "containment"))
    columns, kept = "", f"rank <= {limit}"
    if floor is not None:
        columns, kept = f", best < {floor} AS below_floor", f"CASE WHEN best < {floor} THEN rank <= 20 ELSE raw >= {floor} END"
    return with_lexicon(
        f"""
SELECT query_id, rank, word, reading, score, {four('c_phonetic')} AS phonetic_similarity, {four('c_embedding')} AS embedding_similarity, {four('c_coda')} AS coda_similarity, {four('c_vowel')} AS vowel_similarity, {four('c_mora')} AS mora_similarity, {four('c_containment')} AS containment, mora_count, category, pos, familiarity{columns}
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mora_count, word, reading)::INTEGER AS rank, max(raw) OVER (PARTITION BY query_id) AS best FROM one WHERE n = 1
) WHERE {kept}""",
        f""", {names}, {SOUNDS}, {near},
comps AS (SELECT f.query_id, a.query_text, a.query_reading, f.mora_count, f.phon,
    {f'CASE WHEN f.ratio > 0 THEN 1.0::DOUBLE ELSE {phonetic} END' if holds else phonetic} AS c_phonetic,
    {similarity(edit_distance('a.query_skeleton', 'f.skeleton'), 'a.query_skeleton', 'f.skeleton')} AS c_vowel,
    greatest(0.0::DOUBLE, f.dot * ((SELECT s FROM sp) * (SELECT s FROM sp))) AS c_embedding, greatest(0.0::DOUBLE, f.coda_dot * ((SELECT s FROM sc) * (SELECT s FROM sc))) AS c_coda,
    {mora_similarity('a.query_moras', 'f.mora_count')} AS c_mora, f.ratio AS c_containment FROM found f JOIN asked a USING (query_id), costs),
normal AS (SELECT surface AS query_text, min(normalized) AS query_normal FROM lexicon GROUP BY surface),
words AS (SELECT c.*, l.surface AS word, l.reading, l.pos, l.category, l.familiarity::DOUBLE AS c_familiarity FROM comps c JOIN lexicon l USING (mora_count, phon) LEFT JOIN normal n USING (query_text)
  WHERE l.category IN ({', '.join(map(text, L.DEFAULT_CATEGORIES))}) AND l.surface <> c.query_text AND l.surface IS DISTINCT FROM n.query_normal AND l.reading <> c.query_reading),
scored AS (SELECT *, {score} AS raw, {four(score)} AS score, {three('c_familiarity')} AS familiarity, CASE WHEN word = reading THEN 0.0 WHEN regexp_matches(word, '{P.KANJI}') THEN 1.0 ELSE 0.5 END AS told FROM words),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, reading ORDER BY told DESC, score DESC, familiarity DESC, word DESC) AS n FROM scored)""",
    )


PARTICLES = "particles AS (SELECT * FROM (VALUES " + ", ".join(f"({text(s)}, {text(r)})" for s, r in FUNCTION_WORDS) + ") AS t(surface, reading))"


# Other spaces ---------------------------------------------------------------------------------------------------------


def consonant_vectors(name: str, source: str) -> str:
    """CTEs name(codes, dim, value) by the consonants alone; codes without any have no row."""
    return f"""
{name}_only AS (SELECT codes, regexp_replace(codes, '[^{I.CONSONANT_CODES}]', '', 'g') AS own FROM (SELECT DISTINCT codes FROM {source})),
{name}_at AS (SELECT codes, own, length(own) AS n, unnest(generate_series(0, length(own) - 1)) AS i FROM {name}_only),
{name}_bins AS (SELECT codes, own, n, i, unnest(CASE WHEN n = 1 THEN [0, 1, 2] WHEN i < n // 2 THEN [0, 1] ELSE [0, 2] END) AS bin FROM {name}_at),
{name}_raw AS (SELECT b.codes, b.bin * {E.CONSONANT_BLOCK} + f.dim AS dim, sum(f.value) / any_value(CASE WHEN b.bin = 0 OR b.n = 1 THEN b.n WHEN b.bin = 1 THEN b.n // 2 ELSE b.n - b.n // 2 END) AS value
  FROM {name}_bins b JOIN features f ON f.code = substr(b.own, b.i + 1, 1) AND f.dim < {E.CONSONANT_BLOCK} GROUP BY b.codes, b.bin * {E.CONSONANT_BLOCK} + f.dim),
{name} AS (SELECT codes, dim, value / sqrt(sum(value * value) OVER (PARTITION BY codes)) AS value FROM {name}_raw)"""


def rhythm(code: str) -> str:
    """The eight numbers of a code string's rhythm, as a list."""
    mora = f"[{I.CONSONANT_CODES}]?[{I.VOWEL_CODES}]|[{I.SPECIAL_CODES}]"
    m = f"regexp_extract_all({code}, '({mora})', 1)"
    special = f"list_transform({m}, lambda x: (x IN ('R', 'Q', 'N'))::INTEGER::DOUBLE)"
    share = ", ".join(f"len(list_filter({m}, lambda x: x = '{s}'))::DOUBLE / len({m})" for s in "RQN")
    first = [f"(len({m}) * {i} // 4)" for i in range(5)]
    part = [f"CASE WHEN {b} > {a} THEN list_avg({special}[{a} + 1:{b}]) ELSE {special}[least({a}, len({m}) - 1) + 1] END" for a, b in zip(first[:-1], first[1:], strict=True)]
    return f"[least(len({m}), 12)::DOUBLE / 12, {share}, {', '.join(part)}]"


def rhythm_similarity(a: str, b: str) -> str:
    x, y = rhythm(a), rhythm(b)
    return f"greatest(0.0::DOUBLE, 1 - sqrt(list_sum(list_transform(list_zip({x}, {y}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))"


# Known values of phonemes, independent of the engine's tables -----------------------------------------------------------

# Consonants with the ordinal of their place, manner, voicing, palatalisation and IPA.
CONSONANTS = """c(symbol, place, manner, voiced, palatal, ipa) AS (VALUES
('k', 5, 'stop', 0, 0, 'k'), ('g', 5, 'stop', 1, 0, 'ɡ'), ('ky', 5, 'stop', 0, 1, 'kʲ'), ('gy', 5, 'stop', 1, 1, 'ɡʲ'),
('t', 2, 'stop', 0, 0, 't'), ('d', 2, 'stop', 1, 0, 'd'), ('p', 0, 'stop', 0, 0, 'p'), ('b', 0, 'stop', 1, 0, 'b'), ('py', 0, 'stop', 0, 1, 'pʲ'), ('by', 0, 'stop', 1, 1, 'bʲ'),
('s', 2, 'fricative', 0, 0, 's'), ('z', 2, 'fricative', 1, 0, 'z'), ('sh', 3, 'fricative', 0, 1, 'ɕ'), ('j', 3, 'affricate', 1, 1, 'd͡ʑ'),
('ts', 2, 'affricate', 0, 0, 't͡s'), ('ch', 3, 'affricate', 0, 1, 't͡ɕ'), ('h', 6, 'fricative', 0, 0, 'h'), ('hy', 4, 'fricative', 0, 1, 'ç'),
('f', 0, 'fricative', 0, 0, 'ɸ'), ('fy', 0, 'fricative', 0, 1, 'ɸʲ'), ('v', 1, 'fricative', 1, 0, 'v'),
('n', 2, 'nasal', 1, 0, 'n'), ('ny', 4, 'nasal', 1, 1, 'ɲ'), ('m', 0, 'nasal', 1, 0, 'm'), ('my', 0, 'nasal', 1, 1, 'mʲ'),
('r', 2, 'liquid', 1, 0, 'ɾ'), ('ry', 2, 'liquid', 1, 1, 'ɾʲ'), ('y', 4, 'approximant', 1, 0, 'j'), ('w', 5, 'approximant', 1, 0, 'w'))"""
# Vowels with height, backness, rounding and IPA; special moras with IPA.
VOWELS = "v(symbol, height, back, round, ipa) AS (VALUES ('i', 0, 0, 0, 'i'), ('e', 1, 0, 0, 'e'), ('a', 2, 1, 0, 'a'), ('o', 1, 2, 1, 'o'), ('u', 0, 2, 0, 'ɯ'))"
SPECIALS = "s(symbol, ipa) AS (VALUES ('R', 'ː'), ('Q', 'ʔ'), ('N', 'ɴ'))"
# Distances between manners.
MANNERS = """m(a, b, d) AS (VALUES ('stop', 'affricate', 0.35::DOUBLE), ('stop', 'fricative', 0.65), ('stop', 'nasal', 0.55), ('stop', 'liquid', 0.85), ('stop', 'approximant', 1.0),
('affricate', 'fricative', 0.30), ('affricate', 'nasal', 0.80), ('affricate', 'liquid', 0.90), ('affricate', 'approximant', 1.0), ('fricative', 'nasal', 0.80),
('fricative', 'liquid', 0.85), ('fricative', 'approximant', 0.90), ('nasal', 'liquid', 0.60), ('nasal', 'approximant', 0.80), ('liquid', 'approximant', 0.45))"""

PHONEME_FEATURES = f"""WITH {CONSONANTS}, {VOWELS}, {SPECIALS}
SELECT symbol, 'consonant' AS kind, ipa FROM c UNION ALL SELECT symbol, 'vowel', ipa FROM v UNION ALL SELECT symbol, 'special', ipa FROM s"""

PHONEME_DISTANCES = f"""WITH {CONSONANTS}, {VOWELS}, {SPECIALS}, {MANNERS},
every AS (SELECT symbol, 'c' AS kind FROM c UNION ALL SELECT symbol, 'v' FROM v UNION ALL SELECT symbol, 's' FROM s),
both_c AS (SELECT x.symbol AS a, y.symbol AS b, 0.40::DOUBLE * (abs(x.place - y.place) / 6.0::DOUBLE) + 0.40::DOUBLE * coalesce(m.d, 0) + 0.14::DOUBLE * abs(x.voiced - y.voiced) + 0.06::DOUBLE * abs(x.palatal - y.palatal) AS d
  FROM c x CROSS JOIN c y LEFT JOIN m ON (m.a = x.manner AND m.b = y.manner) OR (m.b = x.manner AND m.a = y.manner)),
both_v AS (SELECT x.symbol AS a, y.symbol AS b, 0.45::DOUBLE * abs(x.height - y.height) / 2 + 0.40::DOUBLE * abs(x.back - y.back) / 2 + 0.15::DOUBLE * abs(x.round - y.round) AS d FROM v x CROSS JOIN v y),
known AS (SELECT * FROM both_c UNION ALL SELECT * FROM both_v)
SELECT x.symbol AS a, y.symbol AS b, {four("CASE WHEN x.symbol = y.symbol THEN 0.0::DOUBLE WHEN k.d IS NOT NULL THEN k.d WHEN x.kind = 's' AND y.kind = 's' THEN CASE WHEN 'R' IN (x.symbol, y.symbol) THEN 0.55::DOUBLE ELSE 0.60::DOUBLE END WHEN 'N' IN (x.symbol, y.symbol) AND (x.symbol IN ('n', 'ny', 'm', 'my') OR y.symbol IN ('n', 'ny', 'm', 'my')) THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END")} AS distance
FROM every x CROSS JOIN every y LEFT JOIN known k ON k.a = x.symbol AND k.b = y.symbol"""
