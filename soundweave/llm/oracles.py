"""SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, secrets, substring_dedup, suffix_dedup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SIZE = substring_dedup.WINDOW
SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - {_SIZE} + 1)) AS i FROM d WHERE len(w) >= {_SIZE}),
windows AS (SELECT r, doc_id, i, sha256(array_to_string(w[i:i + {_SIZE - 1}], ' ')) AS h FROM starts),
gone AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id),
places AS (SELECT DISTINCT r, unnest(generate_series(i, i + {_SIZE - 1})) AS p FROM gone),
lost AS (SELECT r, count(*) AS n FROM places GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN places USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)"""

_ITEM = decontaminate.WINDOW
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item, least({_ITEM}, len(w)) AS size, array_to_string(w[i:i + {_ITEM - 1}], ' ') AS t FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {_ITEM} + 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS t FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT r, i, size, item FROM windows JOIN item_windows USING (size, t)),
places AS (SELECT DISTINCT r, unnest(generate_series(i, i + size - 1)) AS p FROM hits),
n AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN found USING (r)"""

_BYTES = suffix_dedup.SIZE
SUFFIX = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT *, length(x) // 2 AS n FROM d),
windows AS (SELECT r, doc_id, i, md5(substr(x, 2 * i - 1, {2 * _BYTES})) AS h FROM (SELECT r, doc_id, x, unnest(generate_series(1, n - {_BYTES} + 1)) AS i FROM s WHERE n >= {_BYTES})),
gone AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id),
edges AS (SELECT r, i, i > coalesce(max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {_BYTES}, 0) AS fresh FROM gone),
runs AS (SELECT r, i, sum(fresh::INTEGER) OVER (PARTITION BY r ORDER BY i) AS k FROM edges),
spans AS (SELECT r, k, min(i) AS a, max(i) + {_BYTES} AS b FROM runs GROUP BY r, k),
cuts AS (SELECT r, a, b, lag(b, 1, 1) OVER (PARTITION BY r ORDER BY a) AS z FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(x, 2 * z - 1, 2 * (a - z)), '' ORDER BY a) AS t FROM cuts JOIN s USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN t IS NULL THEN x ELSE t || substr(x, 2 * tail - 1) END)) AS kept_sha256 FROM s LEFT JOIN kept USING (r)"""


def _escaped_length(x: str) -> str:
    """The length of a string after escaping: what each control string and each & adds."""
    parts = [f"length({x})", f"4 * (length({x}) - length(replace({x}, '&', '')))"]
    for c in chat.CONTROLS:
        parts.append(f"{len(chat.ENTITIES[c[0]]) - 1} * ((length({x}) - length(replace({x}, '{c}', ''))) // {len(c)})")
    return " + ".join(parts)


_SAYS = "</s>[INST] ok [/INST]"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_SAYS}' UNION ALL SELECT -1, 1, 'assistant', '{_SAYS}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN) + len(chat.TEXT) + len(chat.FINISH)} + {_escaped_length('role')} + {_escaped_length('text')})::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""


def _either(word: str) -> str:
    """A pattern of a word with letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_KEY})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""  # quoted for SQL
_ACCESS, _HEX, _TOKEN = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}", "[A-Za-z0-9+/_-]{20,}"


def _found(kind: int, pattern: str, value: str) -> str:
    """Rows (r, kind, first, until, v) of a pattern's matches: places follow from the lengths of what is between them."""
    return f"""SELECT r, {kind} AS kind, first, first + length(m) AS until, {value} AS v FROM (
  SELECT r, m, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS first FROM (
    SELECT r, gaps, sizes, unnest(ms) AS m, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT r, regexp_extract_all(t, '{pattern}') AS ms, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS sizes, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps
      FROM d WHERE regexp_matches(t, '{pattern}'))))"""


_ENTROPY = "(SELECT -sum(n / length(v)::DOUBLE * log2(n / length(v)::DOUBLE)) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(v, '')) AS c) GROUP BY c))"
_LIVE = f"({_ENTROPY} >= {secrets.LEAST_BITS} AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|your|placeholder|x{{4}}|0{{6}}|12345|abcdef'))"
_JOINED = "coalesce(string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || first || ':' || until, ',' ORDER BY first, kind, until){}, '')"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
base AS ({_found(0, _ASSIGN, f"regexp_extract(m, '{_ASSIGN}', 2)")} WHERE length(v) >= {secrets.ASSIGN_LEAST}
  UNION ALL {_found(1, _ACCESS, 'm')} WHERE length(v) >= {secrets.ACCESS_LEAST} UNION ALL {_found(2, _HEX, 'm')}),
tokens AS ({_found(3, _TOKEN, 'm')}),
mixed AS (SELECT * FROM tokens x WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.first < x.until AND b.until > x.first)),
known AS (SELECT v, {_LIVE} AS live FROM (SELECT DISTINCT v FROM base UNION SELECT DISTINCT v FROM mixed)),
every AS (SELECT * FROM base JOIN known USING (v) UNION ALL SELECT * FROM mixed JOIN known USING (v) WHERE live),
owners AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n_owners FROM every JOIN d USING (r) GROUP BY v),
kept AS (SELECT *, n_owners < {secrets.WIDELY} AS own FROM every JOIN owners USING (v) WHERE kind < 3 OR n_owners < {secrets.WIDELY}),
told AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {_JOINED.format(' FILTER (kind < 3)')} AS base, {_JOINED.format('')} AS spans,
    count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (kind < 3 AND NOT own) AS n_shared, count(*) FILTER (own AND live) AS n_live FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_shared, 0) AS n_shared, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN told USING (r)"""
