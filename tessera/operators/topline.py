"""Aggregates over groups of series, corrected for series that are still short, and their distribution back to series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .transform import daily_growth, weekly, weekly_growth

SUMS = {"daily_level_shrtAdj": "weekly_level_shrtAdj", "daily_level_noShrtAdj": "weekly_level_noShrtAdj", "daily_untouched_noShrtAdj": "weekly_untouched_noShrtAdj"}


def daily(panel: DataFrame, group: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Sums per group and day; the level is scaled by (short + ok) / ok, the medians of series with and without a start."""
    median = F.median("daily_level").over(Window.partitionBy("ts_id"))
    short = F.col("missing_type") == "missing_short"
    sums = panel.withColumn("mid", median).groupBy(*group, "time_d").agg(
        F.coalesce(F.sum("daily_level"), F.lit(0.0)).alias("daily_level_noShrtAdj"),
        F.coalesce(F.sum("daily_untouched"), F.lit(0.0)).alias("daily_untouched_noShrtAdj"),
        F.coalesce(F.sum(F.when(~short, F.col("mid"))), F.lit(0.0)).alias("ok"),
        F.coalesce(F.sum(F.when(short, F.col("mid"))), F.lit(0.0)).alias("short"),
    )
    adjusted = sums.withColumn("shrtAdj_factor", F.try_divide(F.col("short") + F.col("ok"), F.col("ok"))).drop("short", "ok")
    adjusted = adjusted.withColumn("daily_level_shrtAdj", F.col("daily_level_noShrtAdj") * F.col("shrtAdj_factor"))
    return daily_growth(adjusted, "daily_level_shrtAdj", "daily_wowGr_shrtAdj", group)


def weekly_topline(topline: DataFrame, group: tuple[str, ...] = ("grp",)) -> DataFrame:
    return weekly_growth(weekly(topline, SUMS, group), "weekly_level_shrtAdj", "weekly_wowGr_shrtAdj", group)


def distribute(topline: DataFrame, shares: DataFrame, values: list[str], share: str, group: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Group values times each series' share of its group."""
    both = topline.join(shares.select("ts_id", *group, share), list(group))
    return both.select("ts_id", "time_d", *group, *[(F.col(v) * F.col(share)).alias(v) for v in values])
