"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP7 = """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS all_n, sum(pow(n::DOUBLE, 0.7)) AS all_share FROM n),
m AS (SELECT source, pow(n::DOUBLE, 0.7) * all_n::DOUBLE / (all_share * n) AS mean FROM n, t),
-- means above 32 would be drawn as sums; there are none here
k AS (SELECT source, mean, unnest(range(0, 120)) AS k FROM m),
p AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT doc_id, source, lang, n_chars, md5(text) AS text_md5,
             ('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
c AS (SELECT u.doc_id, u.source, u.lang, u.n_chars, u.text_md5, count(p.k) AS copies
      FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source AND p.cdf <= u.u GROUP BY ALL)
SELECT doc_id, source, lang, n_chars, copy_no::INT AS copy_no, substr(md5('mix/order:' || doc_id || ':' || copy_no), 1, 16) AS mix_key, text_md5
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM c)
"""

OP8 = """
WITH captures AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
    lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
vals AS (SELECT DISTINCT * FROM (
    SELECT 'block' AS action, 'host' AS kind, host AS value FROM hosts
    UNION ALL SELECT 'allow', 'prefix', host || '/en' FROM hosts
    UNION ALL SELECT 'block', 'domain', array_to_string(list_slice(string_split(host, '.'), -2, NULL), '.') FROM hosts)),
hashed AS (SELECT *, md5(action || ':' || kind || ':' || value) AS h FROM vals),
firsts AS (SELECT *, DATE '2024-01-01' + (('0x' || substr(h, 1, 3))::INT % 200) AS d1 FROM hashed WHERE substr(h, 12, 1) < 'a'),
lasts AS (SELECT *, d1 + (('0x' || substr(h, 4, 3))::INT % 150 + 1) AS d2 FROM firsts),
agains AS (SELECT *, d2 + (('0x' || substr(h, 7, 3))::INT % 60 + 1) AS d3 FROM lasts),
spans AS (SELECT action, kind, value, d1 AS valid_from, d2 AS valid_to FROM agains
    UNION ALL SELECT action, kind, value, d3, DATE '9999-12-31' FROM agains),
parts AS (SELECT *, [x FOR x IN string_split(path, '/') IF x <> ''] AS p, string_split(host, '.') AS l FROM captures),
keys AS (
    SELECT page_id, fetched, 'host' AS kind, host AS value, 10000 AS rank FROM parts
    UNION ALL SELECT page_id, fetched, 'domain', array_to_string(list_slice(l, i, NULL), '.'), 1000 - i FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM parts)
    UNION ALL SELECT page_id, fetched, 'prefix', host || '/' || lower(array_to_string(list_slice(p, 1, i), '/')), 100000 + i FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)),
hits AS (SELECT k.page_id, k.rank, s.*, row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC, s.action DESC, s.valid_from DESC) AS n
    FROM keys k JOIN spans s ON k.kind = s.kind AND k.value = s.value AND k.fetched >= s.valid_from AND k.fetched < s.valid_to)
SELECT c.page_id, c.url, c.fetched, coalesce(h.action = 'block', false) AS blocked, h.action AS matched_action, h.kind AS matched_kind,
    h.value AS matched_value, h.valid_from::DATE AS matched_from
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.n = 1
"""

OP6 = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (SELECT conv_id, turn, 'call_' || turn AS call_id, text,
    ['search', 'lookup', 'translate'][('0x' || substr(md5(text), 1, 2))::INT % 3 + 1] AS tool, len(string_split(text, ' ')) AS words FROM t WHERE role = 'user'),
results AS (SELECT conv_id, 'call_' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'assistant'),
runs AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM calls),
levels AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) AS position FROM levels),
joined AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.level, c.position, c.tool, c.text, c.words, r.content
    FROM ranked c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, level::INT AS level, position::INT AS position, tool,
    CASE WHEN tool IS NULL THEN 'orphan_result' WHEN tool = 'translate' THEN 'invalid' WHEN content IS NULL THEN 'no_result' ELSE 'ok' END AS status,
    CASE WHEN tool = 'translate' THEN 'missing:target' END AS error,
    '{"arguments":' || coalesce('{"query":' || to_json(text)::VARCHAR || ',"words":' || words || '}', 'null') || ',"id":"' || call_id || '","result":' || coalesce(to_json(content)::VARCHAR, 'null')
        || ',"tool":' || coalesce('"' || tool || '"', 'null') || '}' AS message
FROM joined
"""

OP11 = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
-- the table of crc32, and the crc32 of each conversation's digits, a digit a step
bits AS (SELECT i, 0 AS k, i AS v FROM range(256) AS r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
crc AS (SELECT c, s, 0 AS k, 4294967295::BIGINT AS v FROM ids
    UNION ALL SELECT c, s, k + 1, xor(v >> 8, t[xor(v & 255, ascii(s[k + 1])::BIGINT) + 1]) FROM crc, crc_table WHERE k < length(s)),
heads AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = length(s)),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
rebuilt AS (
    SELECT i.c, t.n AS d, t.k, t.chars FROM heads i JOIN turns t ON t.c = i.c - i.c % 100 AND t.n <= i.h
    UNION ALL SELECT i.c, t.n - i.h + least(i.h, coalesce(g.n, 0)), t.k, t.chars FROM heads i JOIN turns t ON t.c = i.c AND t.n > i.h LEFT JOIN sizes g ON g.c = i.c - i.c % 100),
members AS (SELECT c, 0 AS d, '' AS p, 0 AS chars FROM ids
    UNION ALL SELECT c, d, md5(string_agg(k, '') OVER (PARTITION BY c ORDER BY d)), chars FROM rebuilt),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM members GROUP BY d, p),
ups AS (SELECT DISTINCT m.d, m.p, u.p AS up FROM members m JOIN members u ON u.c = m.c AND u.d = m.d - 1),
children AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM ups GROUP BY ALL),
below AS (SELECT DISTINCT a.d AS ad, a.p AS ap, b.d, b.p FROM members a JOIN members b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT b.ad AS d, b.ap AS p, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves
    FROM below b JOIN nodes n ON n.d = b.d AND n.p = b.p LEFT JOIN children k ON k.d = b.d AND k.p = b.p GROUP BY ALL),
lasts AS (SELECT c, max(d) AS d FROM members GROUP BY c),
ends AS (SELECT m.d, m.p, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends_sha256 FROM members m JOIN lasts l ON l.c = m.c AND l.d = m.d GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
    coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN ups ON ups.d = n.d AND ups.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = ups.up
LEFT JOIN children k ON k.d = n.d AND k.p = n.p LEFT JOIN ends e ON e.d = n.d AND e.p = n.p
"""

OP12 = """
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS v FROM range(256) AS r(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
-- crc32 of document and run, a byte a step
crc AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS s, 0 AS k, 4294967295::BIGINT AS v FROM runs
    UNION ALL SELECT doc_id, run, n, s, k + 1, xor(v >> 8, t[xor(v & 255, ('0x' || substr(s, 2 * k + 1, 2))::BIGINT) + 1]) FROM crc, crc_table WHERE 2 * k < length(s)),
hashed AS (SELECT run, n, xor(v, 4294967295) AS h FROM crc WHERE 2 * k = length(s)),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, j, left(word, j - 1) || substr(word, j + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS j FROM words)),
fewer AS (SELECT DISTINCT p.word, p.n, w.word AS other, w.n AS other_n FROM places p JOIN words w ON w.word = p.rest),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM places a JOIN places b ON a.j = b.j AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
    UNION ALL SELECT word, other, other_n FROM fewer UNION ALL SELECT other, word, n FROM fewer),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS (SELECT w.word, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.at AS root FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""

OP3 = r"""
WITH RECURSIVE lists AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM lists WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT q.doc_id, w.b FROM reached q JOIN ways w ON w.a = q.r)
SELECT q.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(q.r) AS component_id, q.doc_id = min(q.r) AS kept
FROM reached q LEFT JOIN sizes s ON s.doc_id = q.doc_id GROUP BY q.doc_id
"""

ORACLE_SQL = {"op3_superminhash": OP3, "op6_tool_call_linking": OP6, "op7_poisson_mixing": OP7, "op8_temporal_url_filter": OP8, "op11_patricia_trie": OP11, "op12_spelling_variants": OP12}
