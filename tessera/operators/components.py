"""Trim limits, the matrix of component models, and plugging of missing predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import day_of_week
from ..functions.numeric import least_or_null

TRIM_TIMES, CUT_DAYS = 10, 60
PLUG = "mod_sstat_median_last60"
#: Model column -> statistic by weekday, for forecasts and for the validation sample.
SEASONAL = {"mod_sstat_mean": "mean", "mod_sstat_mean_last60": "mean60", "mod_sstat_median": "median", PLUG: "median60"}
SEASONAL_TRUNCATED = {"mod_sstat_mean": "trunc60_mean", "mod_sstat_mean_last60": "trunc60_mean60", "mod_sstat_median": "trunc60_median", PLUG: "trunc60_median60"}


def trim_limits(df: DataFrame, value: str = "daily_level") -> DataFrame:
    """Ten times the maximum, over all days and over those before the cut (strictly, so 61 days are left out)."""
    last = F.broadcast(df.agg(F.date_sub(F.max("time_d"), CUT_DAYS).alias("cut")))
    early = F.max(F.when(F.col("time_d") < F.col("cut"), F.col(value)))
    return df.join(last).groupBy("ts_id").agg((F.max(value) * TRIM_TIMES).alias("trimmax"), (early * TRIM_TIMES).alias("trimmax_trunc60"))


def matrix(series_models: DataFrame, topline_models: DataFrame, limits: DataFrame, by_weekday: DataFrame, limit: str = "trimmax", seasonal: dict[str, str] | None = None) -> DataFrame:
    """ts_id, time_d, the trimmed model columns of both frames, and the seasonal statistics of the day's weekday."""
    seasonal = seasonal or SEASONAL
    models = [c for f in (series_models, topline_models) for c in f.columns if c.startswith("mod_")]
    both = series_models.join(topline_models, ["ts_id", "time_d"]).join(limits.select("ts_id", F.col(limit).alias("trimmax_this")), "ts_id")
    trimmed = both.select("ts_id", "time_d", day_of_week(F.col("time_d")).alias("day_of_week"), *[least_or_null(F.col(c), F.col("trimmax_this")).alias(c) for c in models])
    weekday = by_weekday.select("ts_id", "day_of_week", *[F.col(s).alias(m) for m, s in seasonal.items()])
    return trimmed.join(weekday, ["ts_id", "day_of_week"]).drop("day_of_week")


def plug_missing(models: DataFrame, columns: list[str], plug: str = PLUG) -> DataFrame:
    return models.withColumns({c: F.coalesce(c, plug) for c in columns if c != plug})
