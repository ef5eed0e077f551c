"""SQL for DuckDB, for those queries that it can express."""

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&', '&amp;'), '<|', '&lt;|'), '|>', '|&gt;'), '<s>', '&lt;s>'), '</s>', '&lt;/s>'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]')"

SQL = {
    "op2_chat_formatting": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), l AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM c
), o AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place FROM l
  WINDOW w AS (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_ESCAPED.format("text")}) + CASE WHEN before IS NOT DISTINCT FROM role THEN 5 ELSE 16 + length({_ESCAPED.format("role")}) END)::BIGINT AS formatted_chars
  FROM o GROUP BY conv_id, lone
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
    "op6_weighted_fair_queueing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 15))::BIGINT AS even
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s
), f AS (
  SELECT *, most::DOUBLE / weight AS filled, (sum(source_size) OVER ())::DOUBLE AS budget FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY filled, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY filled, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f
), v AS (SELECT level AS held FROM l WHERE filled > level ORDER BY filled, place LIMIT 1
), t AS (
  SELECT l.*, CASE WHEN filled > held THEN held * weight ELSE most::DOUBLE END AS target FROM l LEFT JOIN v ON true
), q AS (
  SELECT d.*, t.source_size, t.target, t.weight, t.budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.even, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + before + size)::DOUBLE / weight AS finish FROM q, (VALUES (0), (1), (2)) AS e(epoch)
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, even, doc_id, size, epoch ROWS UNBOUNDED PRECEDING) AS served FROM c
)
SELECT doc_id, size, source_size, target, coalesce(sum(size) FILTER (served <= budget), 0)::BIGINT AS taken
FROM r GROUP BY doc_id, even, size, source_size, target
""",
    "op3_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x) AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place, CASE WHEN generate_subscripts(ws, 1) + 19 <= len(ws) THEN array_to_string(list_slice(ws, generate_subscripts(ws, 1), generate_subscripts(ws, 1) + 19), ' ') END AS win FROM w
), r AS (
  SELECT *, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, place) > 1 THEN place END AS again FROM p
), c AS (
  SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM r
), g AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id
""",
    "op4_pivot_permutations": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), u AS (
  SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id != b.vec_id AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), l AS (SELECT a, count(*) AS n FROM e GROUP BY a), m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.least, v.vec_id)) AS component_id, v.vec_id <= coalesce(m.least, v.vec_id) AS kept
FROM v LEFT JOIN l ON l.a = v.vec_id LEFT JOIN m ON m.a = v.vec_id
""",
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), l AS (SELECT a, count(*) AS links FROM e GROUP BY a), m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.links, 0)::BIGINT AS n_links, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN l ON l.a = w.doc_id LEFT JOIN m ON m.a = w.doc_id
""",
    "op8_jump_sharding": """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i))
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':shard'), 1, 15))::HUGEINT AS key,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':slot'), 1, 15))::BIGINT AS even
  FROM documents
), b AS (
  SELECT doc_id, n, key, even, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::INTEGER + 1])))::BIGINT AS crc FROM d, crc
), j AS (
  SELECT doc_id, key AS k, -1::BIGINT AS place, 0::BIGINT AS after, 0 AS step FROM b
  UNION ALL
  SELECT doc_id, k2, after, floor((after + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT, step + 1
  FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j) WHERE after < 9
), s AS (SELECT doc_id, max(place) FILTER (place < 8)::INTEGER AS shard, max(place) FILTER (place < 9)::INTEGER AS grown_shard FROM j GROUP BY doc_id)
SELECT b.doc_id, n + 1 AS size, crc AS text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY even, b.doc_id) - 1)::BIGINT AS slot, grown_shard
FROM b JOIN s ON s.doc_id = b.doc_id
""",
}
