"""DuckDB SQL of the operators that work in rounds or row by row: clustering and conversation repair."""

from __future__ import annotations

from .clustering import centroid_clusters
from .conversations import DELETE, INSERT, REROLE, TRUNCATED

K, ROUNDS, DIM, SCALE, SALT = (centroid_clusters.__defaults__[i] for i in range(5))


def _round(r: int) -> str:
    """Assignment to the centroids c{r}, and the centroids c{r + 1}."""
    return f"""
p{r} AS MATERIALIZED (SELECT v.n, c.k, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM p{r} GROUP BY n),
s{r} AS (SELECT a.k, i, CAST(sum(v.v[i]) AS BIGINT) AS s, count(*) AS m FROM a{r} a JOIN v USING (n), range(1, {DIM + 1}) t(i) GROUP BY 1, 2),
m{r} AS (SELECT k, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (k))"""


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SALT}' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {K})
), {",".join(_round(r) for r in range(ROUNDS + 1))},
t AS (SELECT k, sum(d) AS inertia FROM a{ROUNDS} GROUP BY k)
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(t.inertia AS BIGINT) AS cluster_inertia,
       CAST((SELECT sum(inertia) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a USING (n) JOIN t ON t.k = a.k JOIN c{ROUNDS} c ON c.k = a.k
"""


def _edit(state: str, cost: str, name: str, when: str = "TRUE") -> str:
    """The state's best way with one more edit, or a way that is never taken."""
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE {1 << 40} END, 'a': {state}.a || '{name}'}}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_KEEP, _REROLE, _LATE = "x.late", f"({REROLE} + x.late)", "NOT x.bad"

#: Rows after damage; a forward programme that holds the cheapest (cost, audit) of each of four places; the audit applied.
OP13_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(name, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295), 4294967295) % 20 AS kind FROM named
), harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed
), judged AS (
  SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed
), x AS (
  SELECT *, blank OR again AS bad, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS late FROM judged
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (late > 0) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': ''}} AS s0, {{'c': {1 << 40}, 'a': ''}} AS s1, {{'c': {INSERT}, 'a': 'I'}} AS s2, {{'c': {2 * INSERT}, 'a': 'II'}} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {_least("s3", _edit("s2", str(INSERT), "I"))} FROM (
    SELECT conv_id, i, s0, s1, {_least("s2", *(_edit(s, str(INSERT), "I") for s in ("s0", "s1", "s3")))} AS s2, s3 FROM (
      SELECT w.conv_id, x.i, {_edit("s0", str(DELETE), "D")} AS s0,
        {_least(_edit("s1", str(DELETE), "D"), _edit("s0", _KEEP, "K", f"{_LATE} AND x.r = 's'"))} AS s1,
        {_least(_edit("s2", str(DELETE), "D"), *(_edit(s, _REROLE, "R", _LATE) for s in ("s0", "s1", "s3")), *(_edit(s, _KEEP, "K", f"{_LATE} AND x.r = 'u'") for s in ("s0", "s1", "s3")))} AS s2,
        {_least(_edit("s3", str(DELETE), "D"), _edit("s2", _REROLE, "R", _LATE), _edit("s2", _KEEP, "K", f"{_LATE} AND x.r = 'a'"))} AS s3
      FROM ways w JOIN x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1)
    )
), ends AS (
  SELECT c.*, {_least("s0", "s3")} AS best FROM counts c JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
), letters AS (
  SELECT conv_id, j, substr(best.a, j, 1) AS edit, len(replace(left(best.a, j), 'I', '')) AS i, len(replace(left(best.a, j), 'D', '')) AS m FROM (SELECT *, unnest(range(1, len(best.a) + 1)) AS j FROM ends)
), made AS (
  SELECT l.conv_id, l.j, l.m, l.edit, x.role, CASE WHEN l.edit = 'I' THEN '' ELSE x.text END AS text,
    bool_or(l.m = 1 AND l.edit = 'K' AND x.r = 's') OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.i AND l.edit <> 'I' WHERE l.edit <> 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m % 2 = 1) <> led THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole FROM made GROUP BY conv_id
)
SELECT o.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated, coalesce(e.illegal, 0) AS illegal,
  CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
