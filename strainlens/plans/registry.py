"""Catalogue of registered queries and the SQL each must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strainlens.plans import views_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` names the stand-in views its SQL reads."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = views_sql.with_views(views, sql)
        return fn

    return wrap


def load_all() -> None:
    """Import every catalogue module once."""
    from strainlens.plans import catalog_cohort, catalog_joins, catalog_metrics  # noqa: F401
    from strainlens.plans import catalog_profiles, catalog_sites, catalog_sources  # noqa: F401
    from strainlens.plans import catalog_learning  # noqa: F401
