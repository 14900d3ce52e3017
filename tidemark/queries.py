"""The queries of the process-health operators and SQL for the same results."""

from __future__ import annotations

from tidemark.plans import contract_plans, forecast_plans, health_plans, learning_plans, long_plans, quality_plans, series_plans, source_plans  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
