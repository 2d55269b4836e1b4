"""DuckDB SQL that gives the same rows as the queries of this subpackage that SQL can express."""

from __future__ import annotations

from quire.llm.hosts import BASE_RULES, MOST, RULES
from quire.llm.licenses import CONTAINMENT, TEMPLATES

_SPACE = r"\x20\x09-\x0D"

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM g),
f AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(20) r(j)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM words WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = words.doc_id AND gone.i = words.i) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

LICENSES = f"""
WITH tpl(license, t) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in TEMPLATES.items())}),
src AS (SELECT doc_id AS k, NULL AS license, text AS t FROM documents UNION ALL SELECT NULL, license, t FROM tpl),
w AS (SELECT k, license, regexp_extract_all(lower(coalesce(t, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM src),
s AS (SELECT DISTINCT k, license, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT k, license, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
n AS (SELECT license, count(*) AS n_shingles FROM s WHERE license IS NOT NULL GROUP BY license)
SELECT d.k AS doc_id, t.license, count(*) AS n_found, max(n_shingles) AS n_shingles
FROM s d JOIN s t ON d.s = t.s AND t.license IS NOT NULL JOIN n ON n.license = t.license
WHERE d.k IS NOT NULL GROUP BY d.k, t.license HAVING count(*) >= {CONTAINMENT} * max(n_shingles)
"""

HOSTS = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^{_SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS l FROM d),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(3) r(j) GROUP BY doc_id),
m AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
h AS ({" UNION ALL ".join(f"SELECT host, '{r}' AS rule, count(*) AS n, CAST(count(*) FILTER ({e}) AS DOUBLE) AS f FROM m GROUP BY host" for r, e in RULES.items())}),
t AS (SELECT rule, sum(n) AS total, count(*) AS hosts, sum(f) / sum(n) AS mean FROM h GROUP BY rule),
v AS (SELECT h.rule, total, hosts, least(greatest(any_value(mean), 1e-6), 1 - 1e-6) AS m, sum(n * (f / n - mean) * (f / n - mean)) AS spread FROM h JOIN t USING (rule) GROUP BY h.rule, total, hosts),
b AS (SELECT rule, m, (spread - (hosts - 1) * m * (1 - m)) / total AS between_hosts FROM v),
p AS (SELECT rule, m, CASE WHEN between_hosts > 1e-12 THEN least(greatest(m * (1 - m) / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM b),
verdict AS (SELECT host, max((f + m * strength) / (n + strength)) > {MOST} AS host_failed FROM h JOIN p USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM (SELECT *, {" OR ".join(RULES[r] for r in BASE_RULES)} AS base_failed FROM m) JOIN verdict USING (host)
"""

ORACLE_SQL = {"op4_exact_topk": TOPK, "op5_substring_dedup": SUBSTRINGS, "op6_license_scan": LICENSES, "op7_host_rules": HOSTS}
