"""Registry of named queries: Spark callable + DuckDB oracle SQL (or None).

Each entry binds one operator of the library to the driver's test tables
(see ``plans.testbind``). Callables take ``(spark, sf_dir)`` and return a
DataFrame; all of them read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from talentflow.plans import queries_analytics  # noqa: F401
    from talentflow.plans import queries_ops  # noqa: F401
    from talentflow.plans import queries_text  # noqa: F401
    from talentflow.plans import queries_match  # noqa: F401
    from talentflow.plans import queries_feed  # noqa: F401
    from talentflow.plans import queries_ml  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
