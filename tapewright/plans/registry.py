"""All registered queries over the market tables, and their SQL."""

from __future__ import annotations

from tapewright.plans import bar_queries, criteria_queries, evaluation_queries, feature_queries, indicator_queries, model_queries, outcome_queries, pattern_queries, selection_queries, statistics_queries, table_queries, window_queries

FLAGSHIP = "det3_four_methods"
_FAMILIES = (indicator_queries, bar_queries, pattern_queries, criteria_queries, outcome_queries, evaluation_queries, feature_queries, selection_queries, statistics_queries, table_queries, model_queries, window_queries)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in _FAMILIES for name, sql in family.SQL.items()}
