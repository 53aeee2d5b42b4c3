"""Daily cleaning: missing types, outliers, imputation, in windows over one partitioning by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.numeric import without_negative

SIGMAS, BEFORE, AFTER = 2, 15, 14


def along() -> WindowSpec:
    """A series in time order."""
    return Window.partitionBy("ts_id").orderBy("time_d")


def missing_type(value: str = "daily_untouched") -> Column:
    """no_missing; missing_short before the first value; missing_hole."""
    x = F.col(value)
    first = F.min(F.when(x.isNotNull(), F.col("time_d"))).over(Window.partitionBy("ts_id"))
    return F.when(x.isNotNull(), "no_missing").when(first.isNull() | (F.col("time_d") < first), "missing_short").otherwise("missing_hole")


def rolling_mean(value: str = "daily_untouched") -> Column:
    """Centred mean of 30 rows: 15 before, 14 after."""
    return F.avg(value).over(along().rowsBetween(-BEFORE, AFTER))


def neighbour_mean(x: Column) -> Column:
    """Mean of the same weekday a week before and after; NULL if either is."""
    return (F.lag(x, 7).over(along()) + F.lead(x, 7).over(along())) / 2


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, 0))


def with_missing_type(df: DataFrame) -> DataFrame:
    return df.withColumn("missing_type", missing_type())


def with_outliers(df: DataFrame) -> DataFrame:
    """rolling_mean, and outlier: beyond two population standard deviations of the series from it."""
    x = F.col("daily_untouched")
    df = df.withColumns({"rolling_mean": rolling_mean(), "deviation": F.stddev_pop(x).over(Window.partitionBy("ts_id"))})
    far = (x < F.col("rolling_mean") - SIGMAS * F.col("deviation")) | (x > F.col("rolling_mean") + SIGMAS * F.col("deviation"))
    return df.withColumn("outlier", F.when(far, "outlier").otherwise("ok")).drop("deviation")


def daily_clean(df: DataFrame) -> DataFrame:
    """Adds missing_type, outlier and daily_cleaned. NULL is left only before a series' first value."""
    df = with_outliers(with_missing_type(df))
    kept = F.when(F.col("outlier") == "outlier", F.lit(None)).otherwise(F.col("daily_untouched"))
    df = df.withColumn("kept", kept).withColumn("neighbour", neighbour_mean(F.col("kept")))
    odd = (F.col("missing_type") == "missing_hole") | (F.col("outlier") == "outlier")
    df = df.withColumn("filled", F.when(odd, F.coalesce("neighbour", "rolling_mean")).otherwise(F.col("daily_untouched")))
    return df.withColumn("daily_cleaned", without_negative(forward_fill(F.col("filled")))).drop("rolling_mean", "kept", "neighbour", "filled")
