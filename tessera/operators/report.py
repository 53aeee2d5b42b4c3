"""Reporting queries: counts, shares, top series, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.keys import PARTS


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Rows and their share by category."""
    own = counts(df, by)
    total = df.agg(F.count("*").alias("total"))
    return own.join(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total")).alias("ratio"))


def series_share(df: DataFrame, by: str) -> DataFrame:
    """Share of the series that have a row of the category."""
    total = df.agg(F.count_distinct("ts_id").alias("total"))
    return df.groupBy(by).agg(F.count_distinct("ts_id").alias("n")).join(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("total")).alias("ratio"))


def counts_each(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each of several columns, in one pass: (column, value, n)."""
    grouped = df.groupingSets([[F.col(c)] for c in by], *[F.col(c) for c in by]).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"__{c}") for c in by])
    name = F.coalesce(*[F.when(F.col(f"__{c}") == 0, F.lit(c)) for c in by])
    value = F.coalesce(*[F.when(F.col(f"__{c}") == 0, F.col(c).cast("string")) for c in by])
    return grouped.select(name.alias("column"), value.alias("value"), "n")


def top_series(df: DataFrame, value: str, n: int = 200, without: tuple[str, ...] = ()) -> DataFrame:
    """The n series with the largest totals; ids that contain one of `without` are left out. Ties by id."""
    for part in without:
        df = df.where(~F.col("ts_id").contains(part))
    return df.groupBy("ts_id").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total")).orderBy(F.desc("total"), "ts_id").limit(n)


def top_pages(df: DataFrame, page_map: DataFrame, value: str, n: int = 200, only: dict[str, str] | None = None, without: tuple[str, ...] = (), not_first: tuple[str, ...] = ()) -> DataFrame:
    """The n pages with the largest totals among those of the map that pass the filters: ts_id, total and the page's parts.

    only: part -> value (project, access, agent); names that contain one of `without` or begin with one of `not_first` are left
    out. The map is filtered first, so only its pages' rows are summed. Ties by ts_id.
    """
    kept = page_map
    for part, wanted in (only or {}).items():
        kept = kept.where(F.col(part) == wanted)
    for part in without:
        kept = kept.where(~F.col("name").contains(part))
    for part in not_first:
        kept = kept.where(~F.col("name").startswith(part))
    totals = df.join(kept.select("ts_id"), "ts_id", "left_semi").groupBy("ts_id").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return totals.join(kept.select("ts_id", *PARTS), "ts_id").orderBy(F.desc("total"), "ts_id").limit(n)


def loss_by_rank(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("model_rank").agg(F.avg("loss").alias("loss"), F.count("loss").alias("n"))


def present_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the rows in which each column isn't NULL."""
    wide = df.agg(*[(F.count(c) / F.count("*")).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "share")


def last_days(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last `days` dates of the whole frame."""
    bound = df.agg(F.date_sub(F.max("time_d"), days - 1).alias("__from"))
    return df.join(F.broadcast(bound), F.col("time_d") >= F.col("__from")).drop("__from")


def latest(df: DataFrame, n: int) -> DataFrame:
    """The n latest rows of every series."""
    order = Window.partitionBy("ts_id").orderBy(F.desc("time_d"))
    return df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")
