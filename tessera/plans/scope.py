"""Tables that one query reads several times are written once while it is planned."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession

from ..storage import bucketed, materialize

_KEPT: ContextVar[dict | None] = ContextVar("kept", default=None)


def scoped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query with tables of its own; a query that it calls shares them."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if _KEPT.get() is not None:
            return query(spark, sf)
        # tables in buckets of ts_id join by ts_id and time without a shuffle; set once for the session, as plans are lazy
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        token = _KEPT.set({})
        try:
            return query(spark, sf)
        finally:
            _KEPT.reset(token)

    return run


def once(name: str, make: Callable[[], DataFrame], checks: dict[str, Column] | None = None, by: str | None = None) -> DataFrame:
    """make(), written to the shared folder; within a query the same table for the same name. by: in buckets of this key."""

    def written() -> DataFrame:
        return bucketed(make(), name, by, checks=checks) if by else materialize(make(), name, checks)[0]

    kept = _KEPT.get()
    if kept is None:
        return written()
    if name not in kept:
        kept[name] = written()
    return kept[name]
