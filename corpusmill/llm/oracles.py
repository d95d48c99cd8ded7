"""DuckDB SQL for the operators that SQL can express, at the parameters of the queries."""

from __future__ import annotations

from . import op2_secrets as _op2

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS g FROM pages),
f AS (SELECT g, min(page_id) AS k FROM d WHERE n >= 100 GROUP BY g)
SELECT page_id, n::BIGINT AS payload_bytes, g AS payload_digest, CASE WHEN n >= 100 AND page_id <> k THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> k THEN k END AS refers_to FROM d LEFT JOIN f USING (g)"""


def _spans(pattern: str, kind: int, keep: str = "true") -> str:
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, {pattern})) + 1), lambda i: {{
      's': (list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i - 1], lambda x: length(x))), 0))::INTEGER,
      'k': {kind},
      'e': (list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i], lambda x: length(x))))::INTEGER,
      'ok': {keep}}}), lambda x: x.ok)"""


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ASSIGN, _HEX, _CAND = _literal(_op2.ASSIGN), "'[0-9a-f]{24,}'", "'[A-Za-z0-9+/_=-]{20,}'"
_JOIN = "array_to_string(list_transform({x}, lambda x: ['assign', 'access', 'hex', 'entropy'][x.k + 1] || ':' || x.s || ':' || x.e), ',')"
_SUM = "list_sum(list_transform(map_values(list_histogram(string_split(substr(c, w::INTEGER, 20), ''))), lambda n: [" + ", ".join(map(str, _op2._PLOGP[1:])) + "][n::INTEGER]))"
OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_sort(list_concat({_spans(_ASSIGN, 0, f"length(regexp_extract_all(t, {_ASSIGN}, 2)[i]) >= 6")}, {_spans("'AKIA[A-Z0-9]{16,}'", 1)}, {_spans(_HEX, 2)})) AS base,
  {_spans(_CAND, 3)} AS cand FROM d),
x AS (SELECT doc_id, unnest(cand) AS s, base, t FROM b),
y AS (SELECT doc_id, s, substr(t, s.s + 1, s.e - s.s) AS c FROM x WHERE len(list_filter(base, lambda q: q.s < s.e AND s.s < q.e)) = 0),
z AS (SELECT doc_id, s, c, list_min(list_transform(range(1, length(c) - 18), lambda w: {_SUM})) AS least FROM y WHERE NOT regexp_matches(c, {_literal(_op2.ALLOWED)})),
e AS (SELECT doc_id, list(s) AS more FROM z WHERE least <= CASE WHEN regexp_full_match(c, '[0-9a-fA-F]+') THEN {_op2._limit(_op2.THRESHOLDS["hex"])}
  WHEN regexp_full_match(c, '[A-Za-z0-9]+') THEN {_op2._limit(_op2.THRESHOLDS["alnum"])} ELSE {_op2._limit(_op2.THRESHOLDS["base64"])} END GROUP BY doc_id)
SELECT doc_id, len(list_filter(base, lambda x: x.k = 0))::BIGINT AS n_assign, len(list_filter(base, lambda x: x.k = 1))::BIGINT AS n_access,
  len(list_filter(base, lambda x: x.k = 2))::BIGINT AS n_hex, coalesce(len(more), 0)::BIGINT AS n_entropy, sha256({_JOIN.format(x="base")}) AS base_sha256,
  {_JOIN.format(x="list_sort(list_concat(base, coalesce(more, [])))")} AS spans FROM b LEFT JOIN e USING (doc_id)"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s), u AS (SELECT doc_id, n, unnest(g) AS g FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS nx, any_value(b.n) AS ny FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
pairs AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, pairs.y FROM r JOIN pairs ON pairs.x = r.y)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.y) AS component_id, min(r.y) = n.doc_id AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n"""

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS least FROM k GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN m USING (g) WHERE least < doc_id),
a AS (SELECT doc_id, list(i) AS i FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(i), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, j: NOT coalesce(list_contains(i, j), false)), ' ')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

OP8 = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length(replace(replace(replace(replace(t, '\', '\e'), '[', '\b'), '<', '\l'), '|', '\p')) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 11 + length(role) END AS n,
  CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, regexp_full_match(string_agg(k, '' ORDER BY turn, role, t), 's?(ua)+') AS valid FROM f GROUP BY conv_id"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM k JOIN (SELECT doc_id, g FROM k GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, raw, regexp_extract_all(regexp_replace(translate(raw, '{_UPPER}', '{_LOWER}'), '[0-9]', '0', 'g'), {_WORDS}) AS lw
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS raw FROM d)),
lines AS (SELECT doc_id, source, t, raw, array_to_string(lw, ' ') AS line, len(lw) AS n FROM l WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
freq AS (SELECT source, line, count(DISTINCT t) AS n, min(doc_id) AS keeper FROM lines GROUP BY ALL),
lost AS (SELECT doc_id, sum(lines.n) AS n FROM lines JOIN freq USING (source, line) JOIN hosts USING (source) WHERE freq.n > greatest(20.0, hosts.n * 0.001) AND doc_id <> keeper GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_line_words AS rest FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_line_words, base_failed,
  NOT base_failed AND NOT (n_line_words > 0 AND (rest < 10 OR rest < 0.3 * n_words)) AS kept FROM f"""

OP12 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, i, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(total), 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.total + 2 * v.v) AS p
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""

_PART = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_PART.format(x=x) for x in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: the last bit of crc32 is 0 where the register's, before it is inverted, is 1
_EVEN = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))) & 1 = 1"""
_SIDES = """coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b"""
OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format(text="text")} AS leaf, {_LEAF.format(text="replace(text, chr(10), '')")} AS changed, coalesce({_EVEN}, false) AS hit FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT source, 0 AS level, pos, leaf AS h, n FROM l
  UNION ALL SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM up WHERE n > 1 GROUP BY source, level, pos // 3),
s AS (SELECT source, level AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS h, n FROM s
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), max((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, pos // 3),
x AS (SELECT source, level AS step, pos, {_SIDES} FROM up WHERE n > 1 WINDOW w AS (PARTITION BY source, level, pos // 3 ORDER BY pos)
  UNION ALL SELECT s.source, s.depth + t.level, 0, t.a, t.b
  FROM s JOIN (SELECT level, pos, {_SIDES} FROM top WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 3 ORDER BY pos)) t ON t.pos = s.pos // (3 ** t.level)::BIGINT),
f AS (SELECT source, pos AS leaf_pos, 0 AS step, pos, CASE WHEN hit THEN changed ELSE leaf END AS h, '' AS proof FROM l
  UNION ALL SELECT f.source, leaf_pos, f.step + 1, f.pos // 3, sha256(x.a || f.h || x.b), f.proof || x.a || x.b FROM f JOIN x ON x.source IS NOT DISTINCT FROM f.source AND x.step = f.step AND x.pos = f.pos),
e AS (SELECT source, leaf_pos, h, proof FROM f QUALIFY row_number() OVER (PARTITION BY source, leaf_pos ORDER BY step DESC) = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN e ON e.source IS NOT DISTINCT FROM l.source AND e.leaf_pos = l.pos, (SELECT h FROM top WHERE n = 1) r"""

SQL = {"op1_warc": OP1, "op2_secrets": OP2, "op4_near_dedup": OP4, "op5_substrings": OP5, "op8_chat": OP8, "op10_quality": OP10, "op12_divergence": OP12, "op13_merkle": OP13}
