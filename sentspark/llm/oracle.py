"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     f AS (SELECT page_id, html, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    return (rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


ORACLE["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words('text')} AS w FROM benchmark),
     places AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
                FROM b WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM places),
     sizes AS (SELECT DISTINCT n FROM windows),
     runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
     found AS (SELECT runs.doc_id, runs.i, runs.n, windows.item FROM runs JOIN windows USING (n, k)),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
               FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _clusters() -> str:
    """Five rounds of exact k-means, spelled out."""
    parts = ["""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
             """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 40))"""]
    for i in range(6):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, min([d, cluster]) AS best
  FROM (SELECT vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM v, c{i}) GROUP BY vec_id)""")
        if i < 5:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m
    FROM (SELECT best[2] AS cluster, j, sum(x[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(j) GROUP BY 1, 2)
    GROUP BY cluster) USING (cluster))""")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, CAST(best[2] AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON cluster = best[2]
"""


ORACLE["op11_centroid_clusters"] = _clusters()

ORACLE["op13_collocations"] = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                 '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
     runs AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
     totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
     grams AS (SELECT lang, g, array_to_string(w[i:i + g - 1], ' ') AS phrase
               FROM (SELECT lang, w, g, unnest(range(1, len(w) - g + 2)) AS i
                     FROM runs, range(1, 4) AS r(g) WHERE len(w) >= g)),
     f AS MATERIALIZED (SELECT lang, g, phrase, count(*) AS a FROM grams GROUP BY lang, g, phrase HAVING count(*) >= 10),
     parts AS (SELECT lang, a, string_split(phrase, ' ') AS w FROM f WHERE g = 3),
     longer AS (SELECT lang, phrase, max(a) AS longer FROM (
                  SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM parts
                  UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM parts) GROUP BY lang, phrase),
     kept AS (SELECT f.lang, f.g, f.phrase, f.a, string_split(f.phrase, ' ') AS w
              FROM f LEFT JOIN longer USING (lang, phrase)
              WHERE f.g >= 2 AND (longer IS NULL OR 100 * longer < 50 * f.a)),
     cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
              FROM (SELECT *, unnest(range(1, g)) AS k FROM kept)),
     scored AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r,
                       CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
                FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
     best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
