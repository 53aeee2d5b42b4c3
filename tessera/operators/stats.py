"""Summary statistics over calendar ranges, shares of the total, distributions within the week, describe()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .ranking import quantiles

#: Range name by suffix pattern -> (first, last) in days before the last valid date, both inclusive; None: open.
RANGES: dict[str, tuple[int | None, int | None]] = {
    "{}": (None, None),
    "{}90": (89, None),
    "{}60": (59, None),
    "{}30": (29, None),
    "trunc60_{}": (None, 60),
    "trunc60_{}60": (119, 60),
}
STATISTICS = ("sum", "mean", "median")


def _within(first: int | None, last: int | None) -> Column:
    inside = F.lit(True)
    if first is not None:
        inside = inside & (F.col("time_d") >= F.date_sub(F.col("anchor"), first))
    if last is not None:
        inside = inside & (F.col("time_d") <= F.date_sub(F.col("anchor"), last))
    return inside


def summary(df: DataFrame, keys: tuple[str, ...] = ("ts_id",), value: str = "daily_level") -> DataFrame:
    """18 statistics per key in one aggregation; ranges end at the key's own last valid date. Sums of nothing are 0."""
    anchored = df.withColumn("anchor", F.max(F.when(F.col(value).isNotNull(), F.col("time_d"))).over(Window.partitionBy(*keys)))
    aggregates = []
    for name, (first, last) in RANGES.items():
        x = F.when(_within(first, last), F.col(value))
        aggregates += [F.coalesce(F.sum(x), F.lit(0.0)).alias(name.format("sum")), F.avg(x).alias(name.format("mean")), F.median(x).alias(name.format("median"))]
    return anchored.groupBy(*keys).agg(*aggregates)


#: Share -> the sum that it is a share of.
SHARES = {
    "hist_prop": "sum",
    "hist_prop_last90days": "sum90",
    "hist_prop_last60days": "sum60",
    "hist_prop_last30days": "sum30",
    "hist_prop_trunc60": "trunc60_sum",
    "hist_prop_trunc60_last60days": "trunc60_sum60",
}


def proportions(stats: DataFrame, group: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Each series' share of its group's sums; NULL where the group's sum is 0."""
    whole = Window.partitionBy(*group)
    return stats.select("ts_id", *group, *[F.try_divide(F.col(s), F.sum(s).over(whole)).alias(name) for name, s in SHARES.items()])


def proportions_check(shares: DataFrame, tolerance: float = 1e-6, group: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Groups whose shares don't add up to 1."""
    sums = shares.groupBy(*group).agg(*[F.sum(s).alias(s) for s in SHARES])
    off = F.lit(False)
    for s in SHARES:
        off = off | ~F.coalesce(F.col(s).between(1 - tolerance, 1 + tolerance), F.lit(False))
    return sums.where(off)


def intraweek(by_weekday: DataFrame, value: str = "trunc60_sum60") -> DataFrame:
    """Share of each weekday in the series' week; 1/7 where all weekdays are 0."""
    total = F.sum(value).over(Window.partitionBy("ts_id"))
    return by_weekday.select("ts_id", "day_of_week", F.when(total == 0, F.lit(1.0) / 7).otherwise(F.try_divide(F.col(value), total)).alias("share"))


def describe(df: DataFrame, columns: list[str], group: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, std (sample), min, quartiles (interpolated), max; one row per column and group.

    The quartiles are exact and no task sees all values of a group: see ranking.quantiles().
    """
    long = df.select(*group, F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("column", "v"))
    long, _ = materialize(long, "described")
    keys = (*group, "column")
    found = long.groupBy(*keys).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, "v", [0.25, 0.5, 0.75], keys).select(*[F.col(k).alias(f"__{k}") for k in keys], "q")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    at = lambda i: F.get("q", F.lit(i))
    return found.join(q, same, "left").select(*keys, "count", "mean", "std", "min", at(0).alias("p25"), at(1).alias("p50"), at(2).alias("p75"), "max")
