"""Registry of named queries and their DuckDB oracle twins.

A plan module decorates its query builders with :func:`query`. The oracle text
is the bare SELECT; the fixture CTEs it references are prefixed automatically
(``paysift.plans.fixture_sql``).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture_sql import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

PLAN_MODULES = [
    "paysift.plans.kpi_plans",
    "paysift.plans.analytics_plans",
    "paysift.plans.cleaning_plans",
    "paysift.plans.quality_plans",
    "paysift.plans.report_plans",
    "paysift.plans.search_plans",
    "paysift.plans.profile_plans",
    "paysift.plans.source_plans",
    "paysift.plans.stream_plans",
    "paysift.plans.refresh_plans",
    "paysift.plans.store_plans",
]


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn`` under ``name``; ``sql`` is its oracle SELECT (None = rows-only)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = with_fixtures(sql.strip(), ctes.strip())
        return fn
    return deco


def _load():
    for m in PLAN_MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
