"""All registered queries of the library with their SQL twins."""

from __future__ import annotations

from . import alignment_queries, coarse_queries, fit_queries, grid_queries, metric_queries, residual_queries, series_queries, study_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (grid_queries, series_queries, coarse_queries, metric_queries, fit_queries, alignment_queries, residual_queries, study_queries):
    QUERIES.update(_module.book.queries)
    ORACLE_SQL.update(_module.book.sql)
