"""Fixed-date holidays: labels, factors of holidays that are outliers in every year, and their re-application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Holiday, month, day, projects (None: all).
HOLIDAYS = [
    ("chinese_teachers_day", 9, 10, ["zh"]),
    ("halloween", 10, 31, ["en"]),
    ("toussaint", 11, 1, ["fr"]),
    ("christmas", 12, 25, None),
    ("new_years", 1, 1, None),
]


def holiday_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOLIDAYS, "holiday string, month int, day int, projects array<string>")


def _applied(series: DataFrame, holidays: DataFrame) -> DataFrame:
    """ts_id x holiday for those that apply to the series' project."""
    fits = holidays["projects"].isNull() | F.array_contains(holidays["projects"], series["project"])
    return series.join(F.broadcast(holidays), fits).select("ts_id", "holiday", "month", "day")


def factors(cleaned: DataFrame, holidays: DataFrame) -> DataFrame:
    """Mean of untouched / level over a holiday's days, where all of these are outliers (also if there are none: NULL)."""
    own = _applied(cleaned.select("ts_id", "project").distinct(), holidays)
    days = cleaned.select("ts_id", F.month("time_d").alias("month"), F.day("time_d").alias("day"), "outlier", F.try_divide("daily_untouched", "daily_cleaned").alias("ratio"))
    days = days.join(F.broadcast(holidays.select("month", "day")), ["month", "day"], "left_semi")
    grouped = own.join(days, ["ts_id", "month", "day"], "left").groupBy("ts_id", "holiday", "month", "day")
    found = grouped.agg(F.coalesce(F.bool_and(F.col("outlier") == "outlier"), F.lit(True)).alias("every"), F.avg("ratio").alias("adjustment_factor"))
    return found.where("every").drop("every")


def flags(cleaned: DataFrame, holidays: DataFrame) -> DataFrame:
    """Adds daily_level and holiday: <name>_adj on holidays that have a factor, <name>_noadj on others, else regular_day."""
    has = factors(cleaned, holidays).select("ts_id", "holiday", F.lit(True).alias("adjusted"))
    named = _applied(cleaned.select("ts_id", "project").distinct(), holidays).join(has, ["ts_id", "holiday"], "left")
    label = F.concat("holiday", F.when(F.col("adjusted"), "_adj").otherwise("_noadj"))
    named = named.select("ts_id", "month", "day", label.alias("holiday"))
    keyed = cleaned.withColumns({"month": F.month("time_d"), "day": F.day("time_d"), "daily_level": F.col("daily_cleaned")})
    return keyed.join(named, ["ts_id", "month", "day"], "left").withColumn("holiday", F.coalesce("holiday", F.lit("regular_day"))).drop("month", "day")


def reholiday(models: DataFrame, factor: DataFrame, history: DataFrame, columns: list[str], match: str = "date") -> DataFrame:
    """Multiplies model columns by the factors. match: 'date' needs the day itself in history, 'month_day' any year's."""
    if match == "date":
        days = history.where(F.col("holiday").endswith("_adj")).select("ts_id", "time_d", F.regexp_replace("holiday", "_adj$", "").alias("holiday"))
        at = days.join(factor.select("ts_id", "holiday", "adjustment_factor"), ["ts_id", "holiday"]).select("ts_id", "time_d", "adjustment_factor")
        both = models.join(at, ["ts_id", "time_d"], "left")
    elif match == "month_day":
        at = factor.select("ts_id", F.col("month").alias("__m"), F.col("day").alias("__d"), "adjustment_factor")
        keyed = models.withColumns({"__m": F.month("time_d"), "__d": F.day("time_d")})
        both = keyed.join(at, ["ts_id", "__m", "__d"], "left").drop("__m", "__d")
    else:
        raise ValueError(match)
    times: Column = F.coalesce("adjustment_factor", F.lit(1.0))
    return both.withColumns({c: F.col(c) * times for c in columns}).drop("adjustment_factor")
