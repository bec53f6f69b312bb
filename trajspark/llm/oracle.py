"""SQL of the queries that SQL can express."""

from __future__ import annotations

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), said AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), rows_ AS (
  SELECT texts.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t))::INT AS mask
  FROM texts LEFT JOIN said ON texts.doc_id = said.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows_ GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | f) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & f > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & f > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & f > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & f > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), whole AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS j, v[i] AS c FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)
), book0 AS MATERIALIZED (
  SELECT p, k, j, c FROM whole JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept) USING (vec_id) WHERE k < {entries}
)"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, (m % {entries})::BIGINT AS k, (m // {entries})::BIGINT AS d FROM (
    SELECT vec_id, p, min(d * {entries} + k) AS m FROM (
      SELECT vec_id, w.p, k, sum((w.c - b.c) * (w.c - b.c)) AS d FROM whole w JOIN book{r} b ON w.p = b.p AND w.j = b.j GROUP BY vec_id, w.p, k
    ) GROUP BY vec_id, p)
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.k, b.j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, b.c) AS c FROM book{r} b
  LEFT JOIN (SELECT w.p, a.k, w.j, sum(w.c)::HUGEINT AS s, count(*) AS n FROM whole w JOIN near{r} a USING (vec_id, p) GROUP BY w.p, a.k, w.j) t
  ON b.p = t.p AND b.k = t.k AND b.j = t.j
)""")
    return ", ".join(steps) + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, j)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
