"""From predicted growths and weekly values back to daily levels: recursions as running products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.calendar import day_of_week


def _compound(growth: Column, along) -> Column:
    """Running product of 1 + growth; NULL from the first missing growth on (product() would skip it)."""
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(growth.isNull()).over(so_far)
    return F.when(~broken, F.product(1 + growth).over(so_far))


def daily_growth_to_level(predicted: DataFrame, history: DataFrame, growth: str = "daily_wowGr", level: str = "daily_level", to: str = "daily_wowGr_predbt") -> DataFrame:
    """x[t] = (1 + g[t]) * x[t - 7], from the seven actual days before the sample's first day."""
    first = predicted.groupBy("ts_id").agg(F.min("time_d").alias("first"))
    seeds = history.join(first, "ts_id").where((F.col("time_d") < F.col("first")) & (F.col("time_d") >= F.date_sub("first", 7)))
    seeds = seeds.select("ts_id", day_of_week(F.col("time_d")).alias("dow"), F.col(level).alias("seed"))
    own = predicted.withColumn("dow", day_of_week(F.col("time_d"))).join(seeds, ["ts_id", "dow"], "left")
    along = Window.partitionBy("ts_id", "dow").orderBy("time_d")
    return own.withColumn(to, F.col("seed") * _compound(F.col(growth), along)).drop("dow", "seed")


def fitted_growth_to_level(fitted: DataFrame, growth: str = "daily_wowGr", level: str = "daily_level", to: str = "daily_wowGr_predbt") -> DataFrame:
    """For a sample that starts with the history: seeds are the first seven fitted levels, whose own results stay NULL."""
    series = Window.partitionBy("ts_id").orderBy("time_d")
    own = fitted.withColumns({"k": F.row_number().over(series), "dow": day_of_week(F.col("time_d"))})
    along = Window.partitionBy("ts_id", "dow").orderBy("time_d")
    seed = F.first(level).over(along)
    rest = own.withColumns({"seed": seed, "g": F.when(F.col("k") <= 7, F.lit(0.0)).otherwise(F.col(growth))})
    return rest.withColumn(to, F.when(F.col("k") > 7, F.col("seed") * _compound(F.col("g"), along))).drop("k", "dow", "seed", "g")


def weekly_growth_to_level(predicted: DataFrame, history: DataFrame, growth: str = "weekly_wowGr", level: str = "weekly_level", to: str = "weekly_wowGr_predbt") -> DataFrame:
    """Running product from the actual week before the sample."""
    first = predicted.groupBy("ts_id").agg(F.min("time_w").alias("first"))
    seed = history.join(first, "ts_id").where(F.col("time_w") == F.date_sub("first", 7)).select("ts_id", F.col(level).alias("seed"))
    along = Window.partitionBy("ts_id").orderBy("time_w")
    return predicted.join(seed, "ts_id", "left").withColumn(to, F.col("seed") * _compound(F.col(growth), along)).drop("seed")


def weekly_to_daily(weekly: DataFrame, shares: DataFrame, values: list[str]) -> DataFrame:
    """The week that ends on time_w: its Monday gets share[0] of the value, and so on."""
    both = weekly.join(shares, "ts_id")
    day = F.date_add("time_w", F.col("day_of_week") - 6)
    return both.select("ts_id", day.alias("time_d"), *[(F.col(v) * F.col("share")).alias(v) for v in values])


def combine(daily: DataFrame, weekly_as_daily: DataFrame) -> DataFrame:
    """The daily calendar wins; days without a predicted week are NULL."""
    return daily.join(weekly_as_daily, ["ts_id", "time_d"], "left")


def back_transform(predicted_daily: DataFrame, predicted_weekly: DataFrame, history: DataFrame, weekly_history: DataFrame, shares: DataFrame) -> DataFrame:
    """All four variants of one sample: *_predbt of daily_level, daily_wowGr, weekly_level, weekly_wowGr."""
    daily = daily_growth_to_level(predicted_daily, history).select("ts_id", "time_d", F.col("daily_level").alias("daily_level_predbt"), "daily_wowGr_predbt")
    weeks = weekly_growth_to_level(predicted_weekly, weekly_history).select("ts_id", "time_w", F.col("weekly_level").alias("weekly_level_predbt"), "weekly_wowGr_predbt")
    return combine(daily, weekly_to_daily(weeks, shares, ["weekly_level_predbt", "weekly_wowGr_predbt"]))


def fitted_weekly_growth_to_level(fitted: DataFrame, growth: str = "weekly_wowGr", level: str = "weekly_level", to: str = "weekly_wowGr_predbt") -> DataFrame:
    """For a sample that starts with the history: the seed is the first fitted week, whose own result stays NULL."""
    along = Window.partitionBy("ts_id").orderBy("time_w")
    own = fitted.withColumns({"k": F.row_number().over(along), "seed": F.first(level).over(along)})
    own = own.withColumn("g", F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.col(growth)))
    return own.withColumn(to, F.when(F.col("k") > 1, F.col("seed") * _compound(F.col("g"), along))).drop("k", "seed", "g")


def back_transform_fitted(fitted_daily: DataFrame, fitted_weekly: DataFrame, shares: DataFrame) -> DataFrame:
    """The four variants of the sample that starts with the history, seeded by its own first fitted values."""
    daily = fitted_growth_to_level(fitted_daily).select("ts_id", "time_d", F.col("daily_level").alias("daily_level_predbt"), "daily_wowGr_predbt")
    weeks = fitted_weekly_growth_to_level(fitted_weekly).select("ts_id", "time_w", F.col("weekly_level").alias("weekly_level_predbt"), "weekly_wowGr_predbt")
    return combine(daily, weekly_to_daily(weeks, shares, ["weekly_level_predbt", "weekly_wowGr_predbt"]))
