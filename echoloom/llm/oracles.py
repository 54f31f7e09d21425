"""DuckDB SQL for the rows of the text queries that SQL can express, written from the contracts and the methods."""

from __future__ import annotations

from .fill_middle import MARKS, MIDDLE, PREFIX, RATE, SPM_RATE, SUFFIX, UNIT
from .fill_middle import SEED as FIM_SEED
from .mixing import BLOCK_WORDS, LOT_SHARDS, MAX_REPEATS, SEED, SHARD_WORDS, SHARE, WEIGHTS
from .ownership_secrets import ADDED, BASE, MAX_OWNERS, MAX_REPOSITORIES, MIN_DISTINCT, ORDER
from .quality_divergence import COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_CHARS, MIN_REFERENCE_WORDS, MIN_WORDS
from .reply_trees import END


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(4 + length(replace({_escaped("role")}, '|', '&#124;')) + length({_escaped("text")}) + {len(END)})::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""


def _found(kind: str, pattern: str, group: int, least: int) -> str:
    """Rows (doc, source, own, kind number, start, end, value): gaps between matches and the matches' lengths give the places."""
    p = _quote(pattern)
    return f"""SELECT doc, source, own, {ORDER.index(kind)} AS k, '{kind}' AS kind, a AS "start", a + length(m[i]) AS "end", g[i] AS value FROM (
 SELECT *, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM (
 SELECT doc, source, own, m, g, gaps, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc, source, own, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS g, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})))) WHERE length(g[i]) >= {least}"""


_DIVERSE = f"(kind <> 'mixed' OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT}))"
_BASE = " UNION ALL ".join(_found(k, p, g, n) for k, (p, g, n) in BASE.items())
_ADDED = " UNION ALL ".join(_found(k, p, 0, 1) for k, p in ADDED.items())
SECRETS = f"""WITH d AS (SELECT doc_id AS doc, source, md5(coalesce(text, '')) AS own, coalesce(text, '') AS t FROM documents), b AS ({_BASE}), a AS (SELECT * FROM ({_ADDED}) x WHERE {_DIVERSE}),
 c AS (SELECT * FROM b UNION ALL SELECT * FROM a),
 v AS (SELECT value FROM c GROUP BY value HAVING count(DISTINCT coalesce('=' || source, '')) <= {MAX_REPOSITORIES} AND count(DISTINCT own) <= {MAX_OWNERS}),
 l AS (SELECT doc, count(*) FILTER (WHERE value IN (SELECT value FROM v)) AS n_live, count(*) AS n_all FROM c GROUP BY doc),
 s AS (SELECT doc, kind, k, "start", "end" FROM b UNION ALL SELECT doc, kind, k, "start", "end" FROM a WHERE value IN (SELECT value FROM v)),
 n AS (SELECT doc, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", k) AS base FROM b GROUP BY doc),
 w AS (SELECT doc, string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", k) AS spans FROM s GROUP BY doc)
 SELECT d.doc AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_all - n_live, 0) AS n_copied FROM d LEFT JOIN n ON d.doc = n.doc LEFT JOIN w ON d.doc = w.doc LEFT JOIN l ON d.doc = l.doc"""

_WORDS = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LISTS = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_quote, v))}]" for k, v in COMMON_WORDS.items()) + f" ELSE [{', '.join(map(_quote, COMMON_WORDS['en']))}] END"
_N = len(COMMON_WORDS["en"])


def _share(c: str) -> str:
    return f"list_transform({c}, lambda x: x / greatest(1, list_sum({c})))"


def _js(a: str, b: str) -> str:
    """Base 2 Jensen-Shannon distance of two share lists."""
    half = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    terms = f"list_transform(list_zip({a}, {b}), lambda z: ({half.format('z[1]', 'z[2]')} + {half.format('z[2]', 'z[1]')}) / 2)"
    return f"sqrt(greatest(0, list_sum({terms})))"


def _sums(c: str, n: int) -> str:
    return "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"


QUALITY = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents), w AS (SELECT *, {_WORDS} AS w, {_LISTS} AS v, length(t) AS n_all FROM d),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3), h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
 c AS (SELECT *, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, n_all - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
 n_all - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper, n_all - length(regexp_replace(t, '[0-9]+', '', 'g')) AS n_digit, n_all - length(regexp_replace(t, '[.,;:!?''"()-]+', '', 'g')) AS n_stop,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, regexp_split_to_array(lower(t), '[\x20\x09-\x0D.,;:!?()"'']+') AS bare FROM w),
 m AS (SELECT c.doc_id, lang, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, n_all,
 [word_chars - n_upper - n_digit - n_stop - n_symbols, n_upper, n_digit, n_all - word_chars, n_stop, n_symbols] AS chars, list_transform(v, lambda x: len(list_filter(bare, lambda y: y = x))) AS counts FROM c LEFT JOIN r ON c.doc_id = r.doc_id),
 f AS (SELECT *, list_append(counts, greatest(0, n_words - list_sum(counts))) AS commons, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
 l AS (SELECT lang, sum(n_words) AS words, {_sums("chars", 6)} AS rc, {_sums("commons", _N + 1)} AS rw FROM f WHERE NOT base_failed GROUP BY lang), o AS (SELECT {_sums("rc", 6)} AS ac, {_sums("rw", _N + 1)} AS aw FROM l),
 j AS (SELECT f.*, coalesce(l.rc, o.ac) AS rc, coalesce(l.rw, o.aw) AS rw FROM f CROSS JOIN o LEFT JOIN l ON f.lang = l.lang AND l.words >= {MIN_REFERENCE_WORDS}),
 s AS (SELECT *, {_share("chars")} AS pc, {_share("rc")} AS qc, {_share("commons")} AS pw, {_share("rw")} AS qw FROM j), x AS (SELECT *, {_js("pc", "qc")} AS char_distance, {_js("pw", "qw")} AS word_distance FROM s)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND NOT ((n_all >= {MIN_CHARS} AND char_distance > {MAX_CHAR_DISTANCE}) OR (n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE})) AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM x"""


MIX = rf"""WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), p AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w, {MAX_REPEATS}.0 * source_size AS cap FROM s),
 k AS (SELECT *, sum(cap) OVER o - cap AS capped, sum(w) OVER o - w AS gone FROM p WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
 c AS (SELECT max(({SHARE} * (SELECT sum(source_size) FROM s) - capped) / ((SELECT sum(w) FROM p) - gone)) AS level FROM k), t AS (SELECT source, source_size, least(cap, level * w)::DOUBLE AS target FROM p, c),
 n AS (SELECT round(sum(target) / {BLOCK_WORDS})::BIGINT AS seats FROM t),
 q AS (SELECT source, target / (2 * i + 1) AS q FROM t, n, LATERAL (SELECT unnest(range(0, seats)) AS i) u WHERE target > 0), a AS (SELECT source, count(*) AS quota FROM (SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS FIRST) AS r FROM q), n WHERE r <= seats GROUP BY source),
 e AS (SELECT t.*, coalesce(quota, 0) AS quota, greatest(1, round(source_size / {SHARD_WORDS}))::BIGINT AS shards FROM t LEFT JOIN a ON t.source IS NOT DISTINCT FROM a.source),
 x AS (SELECT d.doc_id, h, d.source, size, source_size, target, quota, shards, ('0x' || left(md5(concat_ws('|', doc_id::VARCHAR, h, '{SEED}')), 8))::BIGINT % shards AS shard FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
 y0 AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota, any_value(shard % ceil(shards / {LOT_SHARDS})::BIGINT) AS lot FROM x GROUP BY source, shard),
 o0 AS (SELECT source, lot, sum(shard_size) AS lot_size, any_value(quota) AS quota FROM y0 GROUP BY source, lot),
 o AS (SELECT source, lot, count(*) AS seats FROM (SELECT source, lot, quota, row_number() OVER (PARTITION BY source ORDER BY lot_size / (2 * i + 1) DESC, lot) AS r FROM o0, LATERAL (SELECT unnest(range(0, quota)) AS i) u WHERE lot_size > 0) WHERE r <= quota GROUP BY source, lot),
 y AS (SELECT y0.source, shard, shard_size, y0.lot, coalesce(seats, 0) AS seats FROM y0 LEFT JOIN o ON y0.source IS NOT DISTINCT FROM o.source AND y0.lot = o.lot),
 z AS (SELECT source, shard, count(*) AS quota FROM (SELECT source, shard, seats, row_number() OVER (PARTITION BY source, lot ORDER BY shard_size / (2 * i + 1) DESC, shard) AS r FROM y, LATERAL (SELECT unnest(range(0, seats)) AS i) u WHERE shard_size > 0) WHERE r <= seats GROUP BY source, shard),
 h AS (SELECT y.source, y.shard, shard_size, coalesce(z.quota, 0) AS quota, shard_size * {MAX_REPEATS} // {BLOCK_WORDS} AS blocks FROM y LEFT JOIN z ON y.source IS NOT DISTINCT FROM z.source AND y.shard = z.shard),
 b AS (SELECT source, shard, block FROM (SELECT source, shard, quota, block, row_number() OVER (PARTITION BY source, shard ORDER BY md5(concat_ws('|', source, shard::VARCHAR, block::VARCHAR, '{SEED}')), block) AS r FROM h, LATERAL (SELECT unnest(range(0, blocks)) AS block) u WHERE quota < blocks) WHERE r <= quota),
 f AS (SELECT *, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY md5(concat_ws('|', doc_id::VARCHAR, h, '{SEED + 1}')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
 g AS (SELECT f.id, sum(greatest(0, least(before + k * shard_size + size, (block + 1) * {BLOCK_WORDS}) - greatest(before + k * shard_size, block * {BLOCK_WORDS}))) AS taken FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source AND f.shard = h.shard JOIN b ON b.source IS NOT DISTINCT FROM f.source AND b.shard = f.shard, (SELECT unnest(range(0, {MAX_REPEATS})) AS k) r GROUP BY f.id)
 SELECT f.doc_id, f.size, f.source_size, round(f.target, 6) AS target, CASE WHEN h.quota >= h.blocks THEN CASE WHEN h.quota > 0 THEN {MAX_REPEATS} * f.size ELSE 0 END ELSE coalesce(g.taken, 0) END::BIGINT AS taken
 FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source AND f.shard = h.shard LEFT JOIN g ON f.id = g.id"""

_DRAW = "('0x' || substr(h, {0}, 8))::UBIGINT".format
FILL_MIDDLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{FIM_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
 u AS (SELECT *, regexp_extract_all(t, {_quote(UNIT)}) AS units FROM d), n AS (SELECT *, len(units) AS n FROM u),
 c AS (SELECT *, least({_DRAW(1)} % (n + 1), {_DRAW(9)} % (n + 1))::BIGINT AS a, greatest({_DRAW(1)} % (n + 1), {_DRAW(9)} % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR {" OR ".join(f"contains(t, '{m}')" for m in MARKS)} OR {_DRAW(17)} % 100 >= {RATE} THEN 'plain' WHEN {_DRAW(25)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM n),
 p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
