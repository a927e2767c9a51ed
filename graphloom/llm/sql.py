"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT cast(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, pos.n AS n, item FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(cast(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST)) % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s0),
s2 AS (SELECT *, 2 * source_size / weight::DOUBLE AS fill FROM s1),
s3 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS weights,
              coalesce(sum(source_size) OVER before, 0) AS size_before, coalesce(sum(weight) OVER before, 0) AS weight_before
       FROM s2 WINDOW before AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - (2 * size_before)::DOUBLE) / (weights - weight_before)::DOUBLE AS own FROM s3),
s5 AS (SELECT *, max(own) OVER () AS level FROM s4),
s6 AS (SELECT *, CASE WHEN fill <= level THEN (2 * source_size)::DOUBLE ELSE weight * level END AS target FROM s5),
s7 AS (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM s6),
s8 AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0) AS low FROM s7),
p AS (SELECT ((i::HUGEINT * 11400714819323198485 + 5700357409661599242) % 18446744073709551616)::DOUBLE / 18446744073709551616::DOUBLE * (SELECT max(high) FROM s8) AS x
      FROM (SELECT unnest(range(cast(ceil((SELECT max(high) FROM s8) / 64) AS BIGINT))) AS i)),
n AS (SELECT source, count(x) AS slots FROM s8 LEFT JOIN p ON x >= low AND x < high GROUP BY source),
s9 AS (SELECT s8.*, least(n.slots * 64, 2 * source_size) AS reach FROM s8 JOIN n ON s8.source IS NOT DISTINCT FROM n.source),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
       cast(greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - start - source_size)) AS BIGINT) AS taken
FROM r JOIN s9 ON r.source IS NOT DISTINCT FROM s9.source
"""

ORACLES = {"op2_decontamination": OP2, "op9_mixing": OP9}
