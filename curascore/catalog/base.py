"""Registry of queries: a Spark callable per name and, where SQL can say it, the SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from curascore.plans.views import with_views_sql

QueryFn = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    run: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), extra: dict[str, str] | None = None):
    """Register the decorated callable; ``sql`` is put behind the named views and ``extra`` CTEs."""

    def add(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(fn, with_views_sql(sql, *views, extra=extra) if sql else None)
        return fn

    return add
