"""All queries of the core, with the SQL that must give the same rows."""

from __future__ import annotations

from gradeloom.plans import data_queries, eval_queries, eval_sql, evaluate_sql, fact_sql

QUERIES = {**eval_queries.QUERIES, **data_queries.QUERIES}
ORACLES = {**eval_sql.ORACLES, **fact_sql.ORACLES, **evaluate_sql.ORACLES, **data_queries.ORACLES}
