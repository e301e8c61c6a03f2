"""SQL of the pN_ queries that SQL can express."""

P5 = """
WITH s AS (
  SELECT DISTINCT accessed_at AS ts, regexp_replace(memory_path, '^_vault/', '') AS p
  FROM access_events WHERE accessed_at IS NOT NULL AND memory_path IS NOT NULL),
n AS (SELECT p, count(*) AS n FROM s GROUP BY p),
t AS (SELECT count(DISTINCT ts) AS n_all FROM s),
ab AS (
  SELECT a.p AS path_a, b.p AS path_b, count(*) AS n_ab
  FROM s a JOIN s b ON a.ts = b.ts AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 8),
f AS (
  SELECT path_a, path_b, na.n AS n_a, nb.n AS n_b, n_ab, n_all
  FROM ab JOIN n na ON na.p = path_a JOIN n nb ON nb.p = path_b, t
  WHERE n_ab * n_all >= 2 * na.n * nb.n)
"""


#: White space and the ends of sentences.
NATURAL = "[\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}.!?。！？]"

P3 = f"""
WITH x AS (SELECT DISTINCT 'messages' AS item_table, message_id AS item_id, content AS t FROM messages WHERE length(content) > 1200
  UNION SELECT 'search_results', result_id, parent_section FROM search_results WHERE length(parent_section) > 1200)
SELECT item_table, item_id, CASE WHEN list_max([length(p) for p in regexp_split_to_array(t, '{NATURAL}')]) > 1200 THEN 'forced' ELSE 'natural' END AS cut FROM x"""

P7 = """
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
i AS (SELECT item_id, regexp_replace(lower(passage), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM eval_items),
dw AS (SELECT doc_id, substr(t, k, 40) AS w FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS k FROM d WHERE length(t) >= 40)),
iw AS (SELECT DISTINCT item_id, substr(t, k, 40) AS w FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS k FROM i WHERE length(t) >= 40))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)"""

P8 = """
WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents WHERE length(text) >= 300)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), o AS (SELECT doc_id, h FROM w SEMI JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM o a JOIN o b ON a.h = b.h AND a.doc_id < b.doc_id"""

P8_AMOUNTS = """
WITH t AS (SELECT text, min(doc_id) AS doc_id, count(*) - 1 AS n_copies FROM documents WHERE length(text) >= 300 GROUP BY text),
w AS (SELECT doc_id, k, md5(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM t)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), o AS (SELECT doc_id, k, h FROM w SEMI JOIN s USING (h)),
c AS (SELECT doc_id, sum(least(300, n)) AS n_shared FROM (SELECT doc_id, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k, 300) AS n FROM o) GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id, h FROM o),
p AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n_partners FROM d a JOIN d b ON a.h = b.h AND a.doc_id != b.doc_id GROUP BY a.doc_id)
SELECT t.doc_id, n_copies, coalesce(n_partners, 0) AS n_partners, CASE WHEN n_copies > 0 THEN length(text) ELSE n_shared END::bigint AS n_shared
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id) WHERE n_copies > 0 OR n_shared IS NOT NULL"""

P8_DOCUMENTS = """
WITH w AS (SELECT doc_id, k, md5(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents WHERE length(text) >= 300)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), o AS (SELECT doc_id, k, h FROM w SEMI JOIN s USING (h)),
c AS (SELECT doc_id, sum(least(300, n))::bigint AS n_shared FROM (SELECT doc_id, coalesce(lead(k) OVER (PARTITION BY doc_id ORDER BY k) - k, 300) AS n FROM o) GROUP BY doc_id),
d AS (SELECT DISTINCT doc_id, h FROM o),
p AS (SELECT a.doc_id, count(DISTINCT b.doc_id) AS n_partners FROM d a JOIN d b ON a.h = b.h AND a.doc_id != b.doc_id GROUP BY a.doc_id)
SELECT doc_id, n_partners, n_shared FROM c JOIN p USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3,
        "p7_found": P7,
        "p8_found": P8,
        "p8_amounts": P8_AMOUNTS,
        "p8_documents": P8_DOCUMENTS,
        "p5_found": P5 + "SELECT path_a, path_b FROM f",
        "p5_scores": P5 + """
SELECT path_a AS item_a, path_b AS item_b, n_a, n_b, n_ab, n_all AS n_baskets,
  round(n_ab * n_all::double / (n_a * n_b), 6) AS lift,
  round(CASE WHEN n_ab < n_a THEN (1 - n_b / n_all::double) / (1 - n_ab / n_a::double) END, 6) AS conviction
FROM f""",
    }
