"""Query catalogue: named plans over the driver's tables plus DuckDB oracles.

Each plan module registers ``name -> fn(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, the equivalent DuckDB SQL over the
raw tables. Outputs use oracle-friendly scalars (arrays joined to text,
timestamps as epoch µs, doubles rounded).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "detection_plans",
    "scrub_plans",
    "ownership_plans",
    "telemetry_plans",
    "enrich_plans",
    "context_plans",
    "rules_plans",
    "triage_plans",
    "cases_plans",
    "kpi_plans",
    "io_plans",
    "stream_plans",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from vigil.session import ensure_defaults

            ensure_defaults(spark)  # UTC event time, AQE, checkpoint folder
            return fn(spark, sf_dir)

        run.__name__, run.__module__, run.__doc__ = fn.__name__, fn.__module__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for m in _MODULES:
        importlib.import_module(f"vigil.plans.{m}")
    return QUERIES, ORACLE
