"""Building panels: dense calendars, wide and long shapes, series ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.calendar import spine
from ..storage import materialize


def dense(sparse: DataFrame, value: str, keys: tuple[str, ...] = ("ts_id",), time: str = "time_d") -> DataFrame:
    """Every series on every date between the first and last of the whole frame; days without rows are NULL.

    sparse has a date at most once for each series. Every row becomes the dates up to the series' next row, so the sparse rows
    are shuffled by series once and the dense panel, which keeps that partitioning, never.
    """
    bounds = sparse.agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    along = Window.partitionBy(*keys).orderBy(time)
    own = sparse.select(*keys, F.col(time).alias("__at"), F.col(value).alias("__x"), F.lead(time).over(along).alias("__next"), F.row_number().over(along).alias("__k"))
    until = F.coalesce(F.date_sub("__next", 1), "__hi")
    since = F.when(F.col("__k") == 1, F.col("__lo")).otherwise(F.col("__at"))
    days = own.join(F.broadcast(bounds)).select(*keys, "__at", "__x", spine(since, until).alias(time))
    return days.select(*keys, time, F.when(F.col(time) == F.col("__at"), F.col("__x")).alias(value))


def wide_to_long(wide: DataFrame, ids: list[str], value: str, time: str = "time_d") -> DataFrame:
    """One row for each series and date-named column."""
    days = [c for c in wide.columns if c not in ids]
    long = wide.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in days], time, value)
    return long.withColumn(time, F.to_date(time, "yyyy-MM-dd"))


def long_to_wide(long: DataFrame, ids: list[str], name: Column, names: list[str], value: str) -> DataFrame:
    """One column for each of `names`; the list is given, so no pass over the data looks for it."""
    return long.withColumn("__name", name).groupBy(*ids).pivot("__name", names).agg(F.first(value, ignorenulls=True))


def series_ids(long: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with a 0-based id in key order. Numbers come from ranks within written ranges, not from one task."""
    ranges = long.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked, _ = materialize(ranges.withColumn("__part", F.spark_partition_id()), "series")  # both branches below read the same ranges
    before = ranked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return ranked.join(F.broadcast(before), "__part").select((F.col("__start") + at - 1).alias("ts_id"), *keys)
