"""DuckDB SQL for the queries of this subpackage that SQL can express.

None for op2 (its patterns look behind), op3 (merges in an order of ranks), op6 (a trained model) and op10 (a trained
model): tests hold those against brute-force versions, the tokenizer's library or held-out accuracy.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
ordered AS (SELECT *, source_size * 3.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS n FROM weighed),
run AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w
  FROM ordered),
level AS (SELECT rest AS l, w AS lw FROM run WHERE rest / w < cap / weight ORDER BY n LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN rest / w >= cap / weight THEN cap ELSE weight * (SELECT l FROM level) / (SELECT lw FROM level) END AS target FROM run),
rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::INT END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed
"""

COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.93),
{COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, coalesce(e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)), true) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

SHARDING = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
entries AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
slim AS (
  SELECT doc_id, octet_length(b)::BIGINT + 1 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM bytes, entries),
run AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n FROM slim),
placed AS (SELECT *, least((2 * before + size) * 16 // (2 * total), 15)::INT AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY n) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM placed
"""

MINHASH = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
{COMPONENTS}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""

REPEATS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 100 <= length(h) THEN md5_number(substr(h, 2 * p + 1, 100)) END AS w
  FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS p FROM texts)),
marked AS (SELECT doc_id, p, byte, w IS NOT NULL AND min(doc_id) OVER (PARTITION BY w) < doc_id AS starts FROM places),
covered AS (SELECT *, coalesce(p - max(CASE WHEN starts THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) < 50, false) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS first FROM covered),
done AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, count(*) FILTER (WHERE first) AS spans, string_agg(byte, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM texts t LEFT JOIN done USING (doc_id)
"""

CHAT = r"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS e, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<|', '<%7C') AS r FROM all_rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(r) + length(e) + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

LEXICAL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY 1),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM sizes),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, nn),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l))))::BIGINT AS score
  FROM b JOIN tf USING (term) JOIN w USING (term) JOIN sizes USING (doc_id), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

NEIGHBOURS = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

MERKLE = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS f FROM documents),
entries AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM documents, entries),
leaves AS (
  SELECT f.*, sha256(f || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 AND contains(text, chr(10)) THEN sha256(f || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')) END AS other,
    (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
  FROM fields f JOIN crc USING (doc_id)),
up AS (
  SELECT 0 AS lvl, g, r, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
  UNION ALL
  SELECT lvl + 1, g, r // 3, sha256(string_agg(h, '' ORDER BY r)), (n + 2) // 3 FROM up WHERE n > 1 GROUP BY lvl, g, r // 3, n),
sub AS (SELECT g AS r, h, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, r, h, n FROM sub
  UNION ALL
  SELECT lvl + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, r // 3, n),
steps AS (
  SELECT l.doc_id, u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.r) FILTER (WHERE u.r < l.r // (3 ** u.lvl)::BIGINT), '') AS a, coalesce(string_agg(u.h, '' ORDER BY u.r) FILTER (WHERE u.r > l.r // (3 ** u.lvl)::BIGINT), '') AS b
  FROM leaves l JOIN up u ON u.g = l.g AND u.n > 1 AND u.r // 3 = (l.r // (3 ** u.lvl)::BIGINT) // 3 GROUP BY l.doc_id, l.r, u.lvl
  UNION ALL
  SELECT l.doc_id, 100 + u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.r) FILTER (WHERE u.r < l.g // (3 ** u.lvl)::BIGINT), ''), coalesce(string_agg(u.h, '' ORDER BY u.r) FILTER (WHERE u.r > l.g // (3 ** u.lvl)::BIGINT), '')
  FROM leaves l JOIN top u ON u.n > 1 AND u.r // 3 = (l.g // (3 ** u.lvl)::BIGINT) // 3 GROUP BY l.doc_id, l.g, u.lvl),
paths AS (SELECT doc_id, list({'a': a, 'b': b, 'h': ''} ORDER BY lvl) AS p FROM steps GROUP BY 1),
done AS (
  SELECT l.doc_id, leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(list_reduce(list_concat([''], list_transform(p, lambda x: x.a || x.b)), lambda x, y: x || y), '')) AS proof_sha256,
    list_reduce(list_concat([{'a': '', 'b': '', 'h': coalesce(other, leaf)}], coalesce(p, [])), lambda x, y: {'a': '', 'b': '', 'h': sha256(y.a || x.h || y.b)}).h AS folded_root
  FROM leaves l JOIN sub ON sub.r = l.g LEFT JOIN paths USING (doc_id))
SELECT *, folded_root = root AS verified FROM done
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": MIXING,
    "op4_embeddings": EMBEDDINGS,
    "op5_sharding": SHARDING,
    "op7_minhash": MINHASH,
    "op8_repeats": REPEATS,
    "op9_chat": CHAT,
    "op11_lexical": LEXICAL,
    "op12_neighbours": NEIGHBOURS,  # exact: all vectors of small tables are one leaf; recall on larger ones is in the tests and the README
    "op13_merkle": MERKLE,
}
