"""DuckDB SQL that states, from the tables alone, what the word, byte and embedding dedup queries must return.

Each judges every window or pair of its table, without anchors, filters or digests shorter than MD5.
"""

from __future__ import annotations

#: op6: a 20-word window goes if its words also start earlier; what any such window covers is removed.
SUBSTRING_WORDS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, a, md5(array_to_string(w[a:a + 19], ' ')) AS body FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS a FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, a FROM win QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, a) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS p FROM again),
one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
"""

#: op7: every pair of one label by its cosine; components by following links from each vector.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS x, b.r AS y FROM fit a JOIN fit b ON a.label = b.label AND a.r <> b.r
WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
reach AS (SELECT r AS x, r AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT reach.x AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x),
links AS (SELECT x AS r, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN comp USING (r) LEFT JOIN links USING (r)
"""

#: op9: windows of bytes that stand at two places or more, joined to runs, and what lies between the runs.
SUFFIX_BYTES = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
win AS (SELECT doc_id, a, md5(t[a:a + 199]) AS body FROM (SELECT doc_id, t, unnest(range(1, octet_length(t) - 198)) AS a FROM d WHERE octet_length(t) >= 200)),
again AS (SELECT doc_id, a FROM win QUALIFY count(*) OVER (PARTITION BY body) > 1),
edge AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER o + 200 THEN 0 ELSE 1 END AS new FROM again WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
span AS (SELECT doc_id, min(a) AS s, max(a) + 199 AS e FROM (SELECT doc_id, a, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM edge) GROUP BY doc_id, g),
before AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM span),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s + 1) AS n_removed, max(e) AS last, string_agg(hex(t[p + 1:s - 1]), '' ORDER BY s) AS kept FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(coalesce(kept, '') || hex(t[coalesce(last, 0) + 1:]))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
