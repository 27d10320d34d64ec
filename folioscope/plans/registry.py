"""Registers queries and shares the SQL of keys and words."""

from __future__ import annotations

from folioscope.functions.textnorm import LATIN_FROM, LATIN_TO


def registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query


def key_sql(text: str = "text") -> str:
    """The Latin key in SQL."""
    return f"trim(regexp_replace(lower(replace(translate(coalesce({text}, ''), '{LATIN_FROM}', '{LATIN_TO}'), 'ß', 'ss')), '[^a-z0-9]+', ' ', 'g'))"


def words_sql(text: str = "text") -> str:
    return f"list_filter(string_split({key_sql(text)}, ' '), lambda w: w <> '')"


#: Word arrays and 3-grams of documents and benchmark, as CTEs.
GRAMS = f"""
tw AS (SELECT doc_id AS id, {words_sql()} AS words FROM documents),
pw AS (SELECT item_id AS id, {words_sql()} AS words FROM benchmark),
tg AS (SELECT id, unnest(range(0, greatest(len(words) - 2, 0))) AS pos, words FROM tw),
pg AS (SELECT id, unnest(range(0, greatest(len(words) - 2, 0))) AS pos, words FROM pw),
t3 AS (SELECT id, pos, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] AS gram FROM tg),
p3 AS (SELECT id, pos, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] AS gram FROM pg),
votes AS (
  SELECT p3.id AS passage_id, t3.id AS text_id, t3.pos - p3.pos AS start, count(*) AS votes
  FROM p3 JOIN t3 USING (gram) GROUP BY 1, 2, 3
)"""
