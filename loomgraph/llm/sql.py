"""DuckDB SQL for the operators that SQL can express."""

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# pages and the targets of their canonical links and refreshes are joined by reachability; the smallest verdict of a component is allow, if any member has it
_URL = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), tag AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM pages
), raw AS (
  SELECT DISTINCT url, CASE WHEN regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS t FROM tag
), full_ AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN root || t
    ELSE root || CASE WHEN folder = '' THEN '/' ELSE folder END || t END AS target
  FROM (SELECT url, t, regexp_extract(url, '^([^:/?#]*):', 1) AS scheme, regexp_extract(url, '^([^:/?#]*):', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) AS root,
    regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM raw WHERE t <> '' AND url IS NOT NULL)
), u AS (
  SELECT url, {_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")} AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS rest
  FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM full_)
), fit AS (
  SELECT url, arg_min(r.h || r.p, (-length(r.h || r.p), r.verdict, r.h || r.p)) AS rule, arg_min(r.verdict, (-length(r.h || r.p), r.verdict, r.h || r.p)) AS verdict
  FROM u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY url
), n AS (SELECT u.*, host || rest AS node, rule, verdict FROM u LEFT JOIN fit USING (url)
), e AS (SELECT a.node AS a, b.node AS b FROM full_ JOIN n a ON a.url = full_.url JOIN n b ON b.url = full_.target WHERE a.host <> '' AND b.host <> ''
), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(node, other) AS (SELECT a, a FROM both_ UNION SELECT r.node, x.b FROM reach r JOIN both_ x ON x.a = r.other
), alias AS (SELECT r.node, min(n.verdict) AS verdict FROM reach r JOIN n ON n.node = r.other AND n.host <> '' GROUP BY 1)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule, coalesce(n.verdict, alias.verdict, 'allow') AS verdict
FROM pages p LEFT JOIN n USING (url) LEFT JOIN alias ON alias.node = n.node AND n.host <> ''
"""

# CRC-32 of UTF-8 bytes has no DuckDB function, so it is folded byte by byte over an expression
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce([n::BIGINT] || list_transform(range(8), lambda z: 0::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

_SHARD = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crc), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce([4294967295::BIGINT] || list_transform(range(size - 1), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t
), j(doc_id, n, k, b, x) AS (
  SELECT doc_id, n, doc_id::UHUGEINT, -1::BIGINT, 0::BIGINT FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (8), (9)) s(n)
  UNION ALL
  SELECT doc_id, n, kk, x, floor((x + 1) * (2147483648.0::DOUBLE / ((kk >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS kk FROM j) WHERE x < n
), s AS (
  SELECT doc_id, (max(b) FILTER (n = 8))::INTEGER AS shard, (max(b) FILTER (n = 9))::INTEGER AS grown_shard FROM j GROUP BY doc_id
)
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, s.shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY md5(c.doc_id || '/' || c.text_crc32)[1:3], c.doc_id, c.size, c.text_crc32) - 1 AS slot, s.grown_shard
FROM c JOIN s USING (doc_id)
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS sh FROM w
), u AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM u x JOIN u y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 85 * (len(x.sh) + len(y.sh) - i)),
twoway AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN twoway b ON b.a = r.other)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""

_NEAR = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id) AS n_links, c.component_id, m.vec_id = c.component_id AS kept FROM embeddings m JOIN c ON c.vec_id = m.vec_id
"""

_REPEATS = """
WITH d AS (SELECT doc_id, h, (length(h) / 2)::BIGINT AS nb FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
w AS (SELECT doc_id, h, unnest(range(0, nb - 99)) AS s FROM d WHERE nb >= 100),
f AS (SELECT doc_id, s FROM (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM w) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
i AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM f),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM i),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY doc_id, g),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a)::BIGINT AS gone, count(*) AS spans FROM r GROUP BY 1),
x AS (SELECT d.doc_id, d.nb, d.h, coalesce(l.a, []::BIGINT[]) AS a, coalesce(l.b, []::BIGINT[]) AS b, coalesce(gone, 0) AS gone, coalesce(spans, 0) AS spans FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, nb AS n_bytes, gone AS n_removed, spans AS n_spans, sha256(unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda k:
  substr(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END) + 1, 2 * ((CASE WHEN k <= len(a) THEN a[k] ELSE nb END) - (CASE WHEN k = 1 THEN 0 ELSE b[k - 1] END)))), ''))) AS kept_sha256
FROM x
"""

_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(length({0}) // 2), lambda i: ('0x' || {0}[2 * i + 1 : 2 * i + 2])::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"

_RESAMPLE = rf"""
WITH t AS (SELECT {_CRC_TABLE} AS crc), d AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM documents
), b AS (SELECT unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
k AS (SELECT f, {_CRC.format("h")} % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM b)), t),
raw AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (f) GROUP BY 1), aim AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain FROM raw LEFT JOIN aim USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS w FROM d JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
s AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
  coalesce(w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN m USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= 20)
SELECT s.*, r.rank FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.rank <= (SELECT 10 * count(*) // 100 FROM r)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
# levels of each source's tree, then of the tree over the sources' roots; a leaf's path is what stands beside it in the runs above it
_MERKLE = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crc), d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '0' || source END AS g, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf,
    CASE WHEN {_CRC.format("k")} % 2 = 0 THEN sha256({_LEAF} || {_FIELD.format("replace(text, chr(10), '')")}) ELSE sha256({_LEAF} || {_FIELD.format("text")}) END AS now
  FROM (SELECT *, hex(encode(doc_id::VARCHAR)) AS k FROM documents), t
), l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
low(g, level, pos, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM l UNION ALL SELECT g, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, level, pos // 3
), sub AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sub UNION ALL SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3
), beside AS (
  SELECT l.g, l.pos AS leaf_pos, x.level AS step, x.pos < l.pos // (3 ** x.level)::BIGINT AS before, x.pos <> l.pos // (3 ** x.level)::BIGINT AS other, x.pos, x.h
  FROM l JOIN low x ON x.g = l.g AND x.n > 1 AND x.pos // 3 = l.pos // (3 ** (x.level + 1))::BIGINT
), above AS (
  SELECT s.g, x.level + 1000 AS step, x.pos < s.pos // (3 ** x.level)::BIGINT AS before, x.pos <> s.pos // (3 ** x.level)::BIGINT AS other, x.pos, x.h
  FROM sub s JOIN top x ON x.n > 1 AND x.pos // 3 = s.pos // (3 ** (x.level + 1))::BIGINT
), p AS (SELECT * FROM beside UNION ALL SELECT l.g, l.pos, step, before, other, a.pos, h FROM l JOIN above a USING (g)),
r AS (SELECT g, leaf_pos, step, coalesce(string_agg(h, '' ORDER BY pos) FILTER (before), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (other AND NOT before), '') AS b FROM p GROUP BY ALL),
w AS (SELECT g, leaf_pos AS pos, string_agg(a || b, '' ORDER BY step) AS path, list(a || '|' || b ORDER BY step) AS steps FROM r GROUP BY 1, 2),
f AS (SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(path, '')) AS proof_sha256,
  list_reduce([now] || coalesce(steps, []), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM l JOIN sub s USING (g) LEFT JOIN w ON w.g = l.g AND w.pos = l.pos)
SELECT *, folded_root = root AS verified FROM f
"""

_MARKS = "(length({0}) - length(replace({0}, chr(92), '')) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7)"
_CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, chr(92) || '### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(role) + length(regexp_replace(role, '[^:#<' || chr(92) || chr(92) || ']', '', 'g')) + length(text) + {_MARKS.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES = {"op3_exact_topk": _TOPK, "op5_url_filters": _URL, "op6_sharding": _SHARD, "op7_ngram_jaccard_join": _JACCARD, "op8_embedding_near_dedup": _NEAR, "op10_suffix_array_dedup": _REPEATS, "op11_importance_resampling": _RESAMPLE, "op12_merkle_manifest": _MERKLE, "op13_chat_formatting": _CHAT}
