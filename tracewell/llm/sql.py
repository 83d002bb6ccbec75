"""DuckDB statements of the queries that SQL can express over whole tables.

The others have none: token counts (3), packing (7) and the token store (9) need a tokenizer, quality rules (4) and licence scans
(8) a learned model.
"""

_WORD = r"[^\x20\x09-\x0D]+"
_FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Labelled pages that a prior is worth, from groups with n, k and the prior mean up.
_STRENGTH = "1 / least(greatest(coalesce(sum(pow(k - n * up, 2) - n * up * (1 - up)) / nullif(sum(n * (n - 1) * up * (1 - up)), 0), 0.1::DOUBLE), 0.001::DOUBLE), 0.5::DOUBLE) - 1"
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), '|', '&vert;')"
#: CRC-32 of a list of bytes, a bit at a time.
_CRC = "xor(list_reduce([4294967295::BIGINT] || {}, lambda s, b: list_reduce([xor(s, b)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
_BYTES = "list_transform(range(1, 2 * octet_length(encode({0})), 2), lambda i: ('0x' || substr(hex(encode({0})), i, 2))::BIGINT)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {
    "op1_chat_format": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<|' || {_ESC.format("role")} || '|>' || CASE WHEN role = 'user' THEN '[INST]' ELSE '' END || chr(10) || {_ESC.format("text")} || CASE WHEN role = 'user' THEN '[/INST]' ELSE '' END || '</s>' || chr(10) AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown))::BIGINT AS formatted_chars FROM f GROUP BY conv_id""",
    "op2_source_mix": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, (('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS n FROM w),
r AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft, (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lw FROM o),
c AS (SELECT *, 3 * source_size * lw <= lft * w AS capped FROM r),
f AS (SELECT lft AS fl, lw AS fw FROM c WHERE NOT capped ORDER BY n LIMIT 1),
g AS (SELECT source, source_size, (CASE WHEN capped OR fl IS NULL THEN 3 * source_size ELSE fl * w / fw END)::DOUBLE AS target FROM c LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN target / source_size - sure > 0 THEN target - sure * source_size ELSE 0 END AS want FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12::DOUBLE)::INT ELSE 0 END AS sure FROM g)),
k AS (SELECT p.source, want, k, pow(2.0::DOUBLE, k * 0.5::DOUBLE) AS g, words FROM p JOIN (SELECT source, len(bin(size)) AS k, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL) q ON p.source IS NOT DISTINCT FROM q.source WHERE want > 0),
m AS (SELECT *, (want - coalesce(sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(words * g) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM k),
e AS (SELECT source, max(k) AS k0, arg_max(c, k) AS c0 FROM m WHERE c * g < 1 GROUP BY source),
i AS (SELECT m.source, m.k, CASE WHEN k0 IS NULL OR m.k > k0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, c0 * g) END AS chance FROM m LEFT JOIN e ON m.source IS NOT DISTINCT FROM e.source),
x AS (SELECT d.*, p.source_size, p.target, p.sure, p.want, CASE WHEN size > 0 THEN CASE WHEN chance >= 1 THEN 0 WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END END AS q
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source AND len(bin(d.size)) = i.k),
y AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM x),
z AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE sure + CASE WHEN q IS NOT NULL AND abs(upto - want) < abs(upto - size - want) THEN 1 ELSE 0 END END AS copies FROM y)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies::INT AS copies, (copies * size)::BIGINT AS taken FROM z""",
    "op5_top_products": """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20""",
    "op6_near_duplicates": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
    "op10_repeated_passages": """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, i, hash(b[i:i + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
hit AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
isle AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM hit)),
run AS (SELECT r, min(i) AS a, max(i) + 399 AS z FROM isle GROUP BY r, n),
gone AS (SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM run GROUP BY r),
part AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM run UNION ALL SELECT r, max(z) + 1, 2000000000 FROM run GROUP BY r),
kept AS (SELECT r, list_reduce(list(CASE WHEN part.a > part.z THEN ''::BLOB ELSE b[part.a:part.z] END ORDER BY part.a), lambda x, y: x || y) AS k FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(k, b)) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op11_importance_resample": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_FEATURE}') AS w FROM documents),
f AS MATERIALIZED (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
g AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_FEATURE}')) AS word FROM benchmark) GROUP BY ALL),
b AS MATERIALIZED (SELECT word, {_CRC.format(_BYTES.format("word"))} % 10000 AS bucket FROM (SELECT word FROM f UNION SELECT word FROM g)),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM g JOIN b USING (word) GROUP BY 1),
x AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT r, floor(sum(n * gain) / sum(n)::DOUBLE)::BIGINT AS weight FROM f JOIN b USING (word) JOIN x USING (bucket) GROUP BY r),
c AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_features >= 20) OVER () AS many FROM c)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM o""",
    "op12_word_runs": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC.format("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} AS h FROM documents),
p AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
m AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM p),
k AS MATERIALIZED (SELECT r, i, hash(w[i + 1:i + 5]) AS k FROM (SELECT r, w, unnest(range(n - 4)) AS i FROM m WHERE n > 4)),
e AS (SELECT x.r, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.r = y.r AND x.k = y.k AND x.i < y.i JOIN m ON m.r = x.r AND 4 * (y.i - x.i) <= m.n),
l AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM e) GROUP BY r, q, isle),
u AS MATERIALIZED (SELECT r, start, length, min(q) AS q FROM l WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
a AS (SELECT r, count(*) AS n_runs, min((-length, start, q)) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM u GROUP BY r),
o AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM u),
c AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(n)) AS i FROM m SEMI JOIN u USING (r)) ANTI JOIN o USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, 1000 * -best[1] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM m LEFT JOIN a USING (r) LEFT JOIN c USING (r)""",
    "op13_host_reputation": f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (quality = 0) AS k FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h AS MATERIALIZED (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k, string_split(host, '.') AS l FROM p LEFT JOIN o USING (page_id) GROUP BY host),
z AS MATERIALIZED (SELECT *, CASE WHEN len(l) > 1 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS two FROM h),
g AS MATERIALIZED (SELECT host, n, k, array_to_string(l[-two:], '.') AS suffix, array_to_string(l[-two - 1:], '.') AS domain FROM z),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.1::DOUBLE) / (sum(n) + 1) FROM g) AS up FROM g GROUP BY 1),
s1 AS (SELECT {_STRENGTH} AS st FROM s0), s AS (SELECT suffix, (up * st + k) / (st + n) AS up FROM s0, s1),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(up) AS up FROM g JOIN s USING (suffix) GROUP BY domain),
d1 AS (SELECT {_STRENGTH} AS st FROM d0), d AS (SELECT domain, (up * st + k) / (st + n) AS up FROM d0, d1),
h0 AS (SELECT host, n, k, up FROM g JOIN d USING (domain)), h1 AS (SELECT {_STRENGTH} AS st FROM h0),
e AS (SELECT host, n, m - 1.645::DOUBLE * sqrt(m * (1 - m) / (st + n + 1)) AS bound FROM (SELECT host, n, st, (up * st + k) / (st + n) AS m FROM h0, h1)),
v(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
f AS (SELECT host, path, arg_max((rule, verdict), length(rule)) AS r FROM (SELECT DISTINCT host, path FROM p) JOIN v ON (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY ALL)
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN bound > 0.2::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, n::BIGINT AS n_labelled, round(bound, 6) AS bad_bound FROM p JOIN e USING (host) LEFT JOIN f USING (host, path)""",
}
