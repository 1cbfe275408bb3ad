"""DuckDB SQL for the training-data queries that SQL can express; the others are tested against plain loops."""

from __future__ import annotations

from .license_texts import TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRAM_WORDS = r"list_filter(string_split_regex(lower({0}), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')"

#: Bigrams that a match at 0.9 cannot all lack: one more of the longest than 1 - 0.9 / 1.1 of a template.
LICENSES = f"""
WITH known(template, license, body) AS (VALUES {", ".join(f"({i}, {_literal(k)}, {_literal(v)})" for i, (k, v) in enumerate(TEMPLATES))}),
kw AS (SELECT template, license, {_GRAM_WORDS.format("body")} AS w FROM known),
ko AS (SELECT template, license, i - 1 AS place, w[i] || ' ' || w[i + 1] AS gram FROM kw, unnest(range(1, len(w))) t(i)),
kg AS (SELECT template, gram, count(*) AS n FROM ko GROUP BY ALL),
ks AS (SELECT template, license, count(*) AS size FROM ko GROUP BY ALL),
ka AS (SELECT template, place, gram FROM ko JOIN ks USING (template)
       QUALIFY row_number() OVER (PARTITION BY template ORDER BY length(gram) DESC, place) <= floor(size * (1 - 0.9 / 1.1) + 1e-9) + 1),
d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT row_id, unnest(list_concat(string_split(text, chr(10)), list_concat(string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text]))) AS unit FROM d),
uw AS (SELECT row_id, row_number() OVER () AS unit_id, {_GRAM_WORDS.format("unit")} AS w FROM u),
ug AS (SELECT row_id, unit_id, w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM uw, unnest(range(1, len(w))) t(i) GROUP BY ALL),
us AS (SELECT row_id, unit_id, sum(n) AS size FROM ug GROUP BY ALL),
mu AS (SELECT us.row_id, template, 2.0 * sum(least(ug.n, kg.n)) / (us.size + ks.size) AS dice
       FROM ug JOIN kg USING (gram) JOIN us USING (unit_id) JOIN ks USING (template) GROUP BY us.row_id, unit_id, template, us.size, ks.size),
dw AS (SELECT row_id, {_GRAM_WORDS.format("text")} AS w FROM d),
dg AS (SELECT row_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS gram FROM dw, unnest(range(1, len(w))) t(i)),
ws AS (SELECT DISTINCT row_id, template, greatest(dg.place - ka.place, 0) AS start FROM dg JOIN ka USING (gram)),
wg AS (SELECT row_id, template, start, dg.gram, count(*) AS n FROM ws JOIN ks USING (template) JOIN dg USING (row_id)
       WHERE dg.place >= start AND dg.place < start + size GROUP BY ALL),
wz AS (SELECT row_id, template, start, sum(n) AS size FROM wg GROUP BY ALL),
mw AS (SELECT row_id, template, 2.0 * sum(least(wg.n, kg.n)) / (wz.size + ks.size) AS dice
       FROM wg JOIN kg USING (template, gram) JOIN wz USING (row_id, template, start) JOIN ks USING (template)
       GROUP BY row_id, template, start, wz.size, ks.size),
h AS (SELECT row_id, license, max(dice) AS dice FROM (FROM mu UNION ALL FROM mw) JOIN ks USING (template) WHERE dice >= 0.9 GROUP BY ALL)
SELECT any_value(d.doc_id) AS doc_id, count(h.license) AS n_matches,
  coalesce(array_to_string(list_sort(list(h.license) FILTER (WHERE h.license IS NOT NULL)), ','), '') AS licenses,
  arg_min(h.license, (-h.dice, h.license)) AS best_license, round(max(h.dice), 6) AS best_dice
FROM d LEFT JOIN h ON d.row_id = h.row_id GROUP BY d.row_id"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM bs, unnest(range(1, len(w) - size + 2)) t(i)),
dg AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram FROM d JOIN (SELECT DISTINCT size FROM bg) z ON len(w) >= size, unnest(range(1, len(w) - size + 2)) t(i)),
h AS (SELECT doc_id, item_id, i, bg.size AS size FROM dg JOIN bg ON dg.size = bg.size AND dg.gram = bg.gram),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

_ESCAPE = r"regexp_replace({0}, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|/?SYS\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"
_ROLE = _ESCAPE.format(r"replace(replace(role, '\', '\b'), chr(10), '\n')")

CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length({_ROLE}) + 1 + length({_ESCAPE.format("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_ROUND = """
d{n} AS MATERIALIZED (SELECT r, p.part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
  SELECT r, p.part, entry, CAST(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist
  FROM p JOIN c{n} c ON p.part = c.part) p GROUP BY ALL),
m{n} AS (SELECT part, entry, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY k) AS x FROM (
  SELECT part, entry, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM d{n} JOIN p USING (r, part), unnest(range(1, len(x) + 1)) t(k) GROUP BY ALL) GROUP BY ALL),
c{m} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (part, entry)),"""

VECTOR_CODES = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, q[part * (len(q) // 8) + 1 : (part + 1) * (len(q) // 8)] AS x FROM v, unnest(range(8)) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < 16),
{"".join(_ROUND.format(n=n, m=n + 1) for n in range(7)).rsplit("m6 AS", 1)[0]}
b AS (SELECT sha256(array_to_string(flatten(list(x ORDER BY part, entry)), ',')) AS codebooks_sha256 FROM c6),
e AS (SELECT r, array_to_string(list(printf('%02x', entry) ORDER BY part), '') AS code, CAST(sum(dist) AS BIGINT) AS error FROM d6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (r), b"""

_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, z: xor(k >> 1, CASE WHEN k & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

PREFIX_TRIE = f"""
WITH o AS (SELECT conv_id AS c, turn, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS sha FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha) - 1 AS p, sha, length(text) AS chars FROM o),
n AS (SELECT c, count(*) AS n, c - c % 100 AS host, {_CRC} % 6 AS h FROM t GROUP BY c),
k AS MATERIALIZED (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS taken FROM n LEFT JOIN n b ON b.c = n.host),
r AS (SELECT k.c, t.p + 1 AS d, sha, chars FROM k JOIN t ON t.c = k.host AND t.p < k.taken
  UNION ALL SELECT k.c, t.p - k.h + k.taken + 1, sha, chars FROM k JOIN t ON t.c = k.c WHERE t.p >= k.h),
x AS MATERIALIZED (SELECT c, d, sha256(string_agg(sha, '') OVER (PARTITION BY c ORDER BY d)) AS node, chars, d = max(d) OVER (PARTITION BY c) AS last FROM r
  UNION ALL SELECT c, 0, '', 0, taken + greatest(n - h, 0) = 0 FROM k),
g AS MATERIALIZED (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS v, bool_and(last) AS leaf,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM x GROUP BY d, node),
below AS (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bn FROM x a JOIN x b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT below.d, below.node, count(*) FILTER (WHERE bd = below.d + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(v) AS BIGINT) AS saved_tokens
  FROM below JOIN g ON g.d = bd AND g.node = bn GROUP BY below.d, below.node),
u AS (SELECT below.bd AS d, below.bn AS node, g.conv_id AS parent_conv_id FROM below JOIN g ON g.d = below.d AND g.node = below.node WHERE bd = below.d + 1)
SELECT g.conv_id, g.d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM g JOIN s ON g.d = s.d AND g.node = s.node LEFT JOIN u ON g.d = u.d AND g.node = u.node"""

ORACLES = {"op1_license_scan": LICENSES, "op2_decontamination": DECONTAMINATION, "op5_topk_search": TOPK, "op6_chat_format": CHATS, "op11_vector_codes": VECTOR_CODES, "op12_prefix_trie": PREFIX_TRIE}
