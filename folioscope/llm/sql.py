"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_filter import DIFFERENT, LEAST_SHARE, LEAST_URLS, MOST_BAD, PRIOR_WEIGHT, RULES

#: All pairs of documents that share a shingle, and the reach of every link.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_n >= 90 * (p.n + q.n - both_n)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS id, x AS reach FROM (SELECT DISTINCT x FROM e) UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.reach),
c AS (SELECT id, min(reach) AS low FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.low, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = w.doc_id
"""

#: The same links at 0.85, and which document of a component is kept.
OP11_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP6_SQL.replace('>= 90 *', '>= 85 *')})"

#: The same integers, all pairs of queries and candidates.
OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: Levels of the template tree that the SQL spells out; it stops with an error at a deeper path under an open node.
LEVELS = 6


def _level(d: int) -> str:
    """One level of the template tree: t{d} to t{d + 1}; finished rows have done."""
    w = PRIOR_WEIGHT
    differs = f"""CASE WHEN f.fk > 0 AND o.known > 0 AND f.fb + o.bad > 0 AND f.fb + o.bad < f.fk + o.known
      THEN abs(f.fb / f.fk - o.bad / o.known) / sqrt((f.fb + o.bad) / (f.fk + o.known) * (1 - (f.fb + o.bad) / (f.fk + o.known)) * (1 / f.fk + 1 / o.known)) > {DIFFERENT} ELSE false END"""
    return f"""
n{d} AS (SELECT host, template, sum(n) AS pn FROM t{d} WHERE NOT done GROUP BY 1, 2),
r{d} AS (SELECT t.*, pn, pn < {LEAST_URLS} AS small, CASE WHEN len(parts) <= {d} THEN '' WHEN parts[{d + 1}] = '' THEN '/' ELSE parts[{d + 1}] END AS seg FROM t{d} t JOIN n{d} USING (host, template) WHERE NOT done),
c{d} AS (SELECT host, template, seg, sum(n) AS n, sum(known) AS known, sum(bad) AS bad, max(pn) AS pn, count(*) OVER (PARTITION BY host, template) AS kids FROM r{d} WHERE NOT small GROUP BY host, template, seg),
b{d} AS (SELECT *, CASE WHEN seg = '' THEN '' WHEN n < {LEAST_URLS} OR n < pn * {LEAST_SHARE}::DOUBLE OR (known = 0 AND kids > 1) THEN '*' ELSE seg END AS branch FROM c{d}),
g{d} AS (SELECT host, template, branch, sum(known)::DOUBLE AS known, sum(bad)::DOUBLE AS bad FROM b{d} WHERE branch <> '' GROUP BY 1, 2, 3),
h{d} AS (SELECT *, coalesce(sum(bad) OVER w / nullif(sum(known) OVER w, 0), 0.0::DOUBLE) AS rate FROM g{d} WINDOW w AS (PARTITION BY host, template)),
o{d} AS (SELECT *, row_number() OVER (PARTITION BY host, template ORDER BY (bad + {w}::DOUBLE * rate) / (known + {w}::DOUBLE), branch) AS i FROM h{d}),
f{d} AS (
  SELECT host, template, branch, i, 1 AS grp, known AS fk, bad AS fb FROM o{d} WHERE i = 1
  UNION ALL
  SELECT o.host, o.template, o.branch, o.i, CASE WHEN {differs} THEN f.grp + 1 ELSE f.grp END,
    CASE WHEN {differs} THEN o.known ELSE f.fk + o.known END, CASE WHEN {differs} THEN o.bad ELSE f.fb + o.bad END
  FROM f{d} f JOIN o{d} o ON o.host = f.host AND o.template = f.template AND o.i = f.i + 1
),
m{d} AS (SELECT *, count(*) OVER g AS members, min(branch) OVER g AS low, max(CASE WHEN branch = '*' THEN 1 ELSE 0 END) OVER g AS wild, max(grp) OVER (PARTITION BY host, template) AS k FROM f{d} WINDOW g AS (PARTITION BY host, template, grp)),
s{d} AS (SELECT host, template, branch, CASE WHEN wild = 1 OR (k = 1 AND members > 1) THEN '/*' WHEN members = 1 THEN '/' || branch ELSE '/[' || low || ',*]' END AS step FROM m{d}),
e{d} AS (SELECT b.host, b.template, b.seg, coalesce(step, '') AS step FROM b{d} b LEFT JOIN s{d} s ON s.host = b.host AND s.template = b.template AND s.branch = b.branch),
t{d + 1} AS (
  SELECT * FROM t{d} WHERE done
  UNION ALL SELECT host, shape, parts, n, known, bad, template || repeat('/*', greatest(len(parts) - {d}, 0)), true FROM r{d} WHERE small
  UNION ALL SELECT r.host, r.shape, r.parts, r.n, r.known, r.bad, r.template || e.step, len(r.parts) <= {d + 1} FROM r{d} r JOIN e{d} e ON e.host = r.host AND e.template = r.template AND e.seg = r.seg WHERE NOT r.small
)"""


def _op3_sql() -> str:
    fits = {}
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        fits[rule] = (f"(u.host = '{host}' OR ends_with(u.host, '.{host}')) AND starts_with(u.path, '/{path}')", verdict)
    rules = " ".join(f"WHEN {c} THEN '{r}'" for r, (c, _) in fits.items())
    verdicts = " ".join(f"WHEN {c} THEN '{v}'" for c, v in fits.values())
    hexed = "regexp_replace(path, '/[0-9a-fA-F-]{16,}(/|\\.|$)', '/~\\1', 'g')"
    hexed = hexed.replace("(path,", f"({hexed},")
    return f"""
WITH RECURSIVE rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
u AS (SELECT *, regexp_replace(regexp_replace({hexed}, '[0-9]+', '#', 'g'), '^/', '') AS shape FROM hp),
lb AS (SELECT doc_id AS page_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t0 AS (SELECT host, shape, string_split(shape, '/') AS parts, count(*) AS n, count(bad) AS known, coalesce(sum(bad), 0) AS bad, '' AS template, false AS done FROM u LEFT JOIN lb USING (page_id) GROUP BY host, shape),
{",".join(_level(d) for d in range(LEVELS))},
t AS (SELECT host, shape, n, known, bad, CASE WHEN done THEN template ELSE error('a path is deeper than the levels of this SQL') END AS template FROM t{LEVELS}),
pr AS (SELECT CASE WHEN sum(known) > 0 THEN sum(bad) / sum(known)::DOUBLE ELSE 0 END AS prior FROM t),
jd AS (SELECT host || template AS name, CASE WHEN (sum(bad) + {PRIOR_WEIGHT} * max(prior)) / (sum(known) + {PRIOR_WEIGHT})::DOUBLE > {MOST_BAD} THEN 'block' ELSE 'allow' END AS method FROM t, pr GROUP BY 1)
SELECT u.page_id, u.host, u.path, CASE {rules} END AS rule, CASE {verdicts} ELSE jd.method END AS verdict, jd.name AS template
FROM u JOIN t ON t.host = u.host AND t.shape = u.shape JOIN jd ON jd.name = t.host || t.template
"""


OP3_SQL = _op3_sql()
