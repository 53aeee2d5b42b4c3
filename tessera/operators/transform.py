"""Growth, weekly roll-ups and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.calendar import day_of_week, first_monday, last_sunday, week_ending
from ..functions.numeric import one_for_zero


def _along(keys: tuple[str, ...], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def growth(df: DataFrame, value: str, to: str, lag: int, keys: tuple[str, ...] = ("ts_id",), time: str = "time_d") -> DataFrame:
    """x / lag(x) - 1, with 1 in the place of 0 on either side."""
    x = one_for_zero(F.col(value))
    return df.withColumn(to, x / F.lag(x, lag).over(_along(keys, time)) - 1)


def daily_growth(df: DataFrame, value: str = "daily_level", to: str = "daily_wowGr", keys: tuple[str, ...] = ("ts_id",)) -> DataFrame:
    return growth(df, value, to, 7, keys).withColumn("day_of_week", day_of_week(F.col("time_d")))


def whole_weeks(df: DataFrame) -> DataFrame:
    """Without the days of a first or last week that the calendar cuts; time_w is the week's Sunday."""
    bounds = df.agg(first_monday(F.min("time_d")).alias("__lo"), last_sunday(F.max("time_d")).alias("__hi"))
    kept = df.join(F.broadcast(bounds), F.col("time_d").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
    return kept.withColumn("time_w", week_ending(F.col("time_d")))


def weekly(df: DataFrame, sums: dict[str, str], keys: tuple[str, ...] = ("ts_id",)) -> DataFrame:
    """Sums over whole weeks, 0 where all days are missing. sums: daily column -> weekly column."""
    return whole_weeks(df).groupBy(*keys, "time_w").agg(*[F.coalesce(F.sum(a), F.lit(0.0)).alias(b) for a, b in sums.items()])


def weekly_growth(df: DataFrame, value: str = "weekly_level", to: str = "weekly_wowGr", keys: tuple[str, ...] = ("ts_id",)) -> DataFrame:
    return growth(df, value, to, 1, keys, "time_w")


def differences(df: DataFrame, value: str, d: int, seasonal: int, season: int = 7, to: str = "diff") -> DataFrame:
    """value differenced d times at lag 1, then `seasonal` times at lag `season`. Lags of lags are spelled out, as windows don't nest."""
    terms = [(0, 1)]
    for lag, times in ((1, d), (season, seasonal)):
        for _ in range(times):
            terms = [*terms, *((at + lag, -sign) for at, sign in terms)]
    along = _along(("ts_id",), "time_d")
    x = F.lit(0.0)
    for at, sign in terms:
        part = F.lag(value, at).over(along) if at else F.col(value)
        x = x + part if sign > 0 else x - part
    return df.withColumn(to, x)
