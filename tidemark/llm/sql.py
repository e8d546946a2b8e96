"""DuckDB SQL for the corpus operators that SQL can express."""

WORDS = r"regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+')"

ORACLE = {
    "op1_ngram_jaccard": rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM g GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS rep, min(n) AS n FROM s GROUP BY k),
r AS (SELECT rep, n, g FROM g JOIN c ON g.doc_id = c.rep),
p AS (SELECT a.rep AS doc_a, b.rep AS doc_b, count(*) AS x, min(a.n) AS na, min(b.n) AS nb
      FROM r a JOIN r b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
m AS (SELECT k, count(*) AS many FROM s GROUP BY k),
e AS (SELECT doc_a, doc_b FROM p WHERE 5 * x >= 2 * (na + nb - x)),
l AS (SELECT rep, sum(many) AS links
      FROM (SELECT doc_a AS rep, doc_b AS other FROM e UNION ALL SELECT doc_b, doc_a FROM e) JOIN (SELECT rep AS other, many FROM c JOIN m USING (k)) USING (other) GROUP BY rep)
SELECT d.doc_id, coalesce(c.rep, d.doc_id) AS class_id, CAST(coalesce(m.many - 1, 0) + coalesce(l.links, 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.k = s.k LEFT JOIN m ON m.k = s.k LEFT JOIN l ON l.rep = c.rep
""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, line, i, length(trim(line, ' ')) >= 10
             AND row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, i) > 1 AS gone FROM l),
r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text,
             CAST(count(*) FILTER (gone) AS INTEGER) AS lines_removed FROM k GROUP BY doc_id)
SELECT doc_id, text, lines_removed FROM r
UNION ALL
SELECT doc_id, text, CAST(0 AS INTEGER) FROM documents WHERE doc_id IS NULL OR text IS NULL
""",
    "op7_decontaminate": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) >= 3)),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 7 + 1)) AS i FROM d WHERE len(w) >= 8)),
short AS (SELECT DISTINCT item_id, s FROM p WHERE len(string_split(s, ' ')) < 8)
SELECT doc_id, CAST(item_id AS VARCHAR) AS item FROM g JOIN p USING (s)
UNION
SELECT doc_id, CAST(item_id AS VARCHAR) FROM d JOIN short ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || s || ' ')
""",
}
