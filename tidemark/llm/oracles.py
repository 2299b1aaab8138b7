"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.queries import LISTED_HOSTS, URL_RULES

_RULES = ", ".join(f"('{r.partition('/')[0]}', '{'/' + r.partition('/')[2]}', '{r}', '{v}')" for r, v in URL_RULES)
_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED_HOSTS)

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_SPACE = r"'[\x20\x09-\x0D]'"


def _letters(column: str) -> str:
    """A-Z lower-cased and nothing else."""
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP4 = f"""
WITH rules(rule_host, rule_path, rule, verdict) AS (VALUES {_RULES}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') END AS rest FROM pages),
parts AS (SELECT page_id, coalesce({_letters("regexp_replace(rest, '/.*$', '', 's')")}, '') AS host,
  CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_LISTED} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""

_ESCAPED = r"replace(replace(coalesce({0}, ''), '\', '\\'), '<|', '<\|')"

OP6 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + length('<|turn|><|says|><|end|>'))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP8 = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, list_transform({_WORDS}, lambda x: {_letters("x")}) AS w FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, least(d.doc_id, coalesce(y, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of ON x = d.doc_id
"""

OP9 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce({_WORDS}, []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
rows_of AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n, count(*) AS lines FROM rows_of GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, (length(text) - length(regexp_extract_all(text, {_SPACE}).array_to_string('')))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0) AS n_lines
  FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id)),
bits AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT
  + 8 * (n_lines >= 8 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (n_words > 0 AND (2 * word_chars < 3 * n_words OR word_chars > 40 * n_words))::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed FROM bits
"""

_CRC = "xor(list_reduce([4294967295::BIGINT] || {0}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _crc32(text: str) -> str:
    """Unsigned crc32 of UTF-8 bytes, bit by bit."""
    return _CRC.format(f"list_transform(range(0, strlen({text})), lambda i: 16 * (strpos('0123456789ABCDEF', hex({text})[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', hex({text})[2 * i + 2]) - 1)")


OP12 = rf"""
WITH said AS (SELECT doc_id, regexp_extract_all({_letters("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT unnest(regexp_extract_all({_letters("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
own AS (SELECT doc_id, f, count(*) AS k FROM (SELECT doc_id, unnest(w) AS f FROM said) GROUP BY ALL),
names AS (SELECT f, {_crc32("f")} % 10000 AS bucket FROM (SELECT f FROM own UNION SELECT f FROM wanted)),
s AS (SELECT bucket, sum(k) AS s FROM own JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN names USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weighed AS (SELECT doc_id, sum(k) AS n, sum(k * gain) AS g FROM own JOIN names USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln(((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, weight + noise AS score, r AS rank FROM scored s LEFT JOIN ranked ON ranked.doc_id = s.doc_id AND r <= n * 10 // 100
"""

_TURN = "sha256(strlen(role) || ':' || role || text)"

OP13 = f"""
WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, {_TURN}) AS p FROM said),
convs AS (SELECT c, {_crc32("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM said)),
taken AS (SELECT v.c, v.h, count(t.p) AS k FROM convs v LEFT JOIN turns t ON t.c = v.c - v.c % 5 AND t.p <= v.h GROUP BY ALL),
made AS (SELECT v.c, t.p AS d, role, text FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.p <= v.h
  UNION ALL SELECT v.c, k + t.p - h, role, text FROM taken v JOIN turns t ON t.c = v.c AND t.p > v.h),
paths AS (SELECT c, d, strlen(text) AS bytes, string_agg({_TURN}, '') OVER (PARTITION BY c ORDER BY d) AS path FROM made UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM paths GROUP BY ALL),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM paths GROUP BY c) GROUP BY path),
inner_ones AS (SELECT path[:length(path) - 64] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (SELECT path[:64 * k] AS path, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (i.path IS NULL) AS leaves
  FROM (SELECT n.*, unnest(range(0, d + 1)) AS k FROM nodes n) n LEFT JOIN inner_ones i USING (path) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(i.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[:length(n.path) - 64] LEFT JOIN inner_ones i ON i.path = n.path LEFT JOIN ends e ON e.path = n.path
"""

ORACLES = {"op4_url_filters": OP4, "op6_chat_formatting": OP6, "op8_minhash_near_dedup": OP8, "op9_quality_rules": OP9, "op12_importance_resampling": OP12, "op13_prefix_trie": OP13}
