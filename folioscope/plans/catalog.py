"""All queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from folioscope.plans import answer_queries, key_queries, layout_queries, relational, retrieval_queries, rule_queries, text_queries, unit_queries, verse_queries, view_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (text_queries, retrieval_queries, rule_queries, relational, key_queries, verse_queries, layout_queries, unit_queries, answer_queries, view_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
