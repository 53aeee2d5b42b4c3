"""The submission key, forecasts joined to it, and scores against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import PARTS, split_right
from ..functions.numeric import smape


def parse_key(pages: DataFrame, page: str = "Page") -> DataFrame:
    """Adds name, project, access, agent of a page key."""
    return pages.withColumns(dict(zip(PARTS, split_right(F.col(page), 4), strict=True)))


def parse_dated_key(keys: DataFrame, page: str = "Page") -> DataFrame:
    """Adds name, project, access, agent and time_d of a key that ends in a date."""
    *parts, day = split_right(F.col(page), 5)
    return keys.withColumns(dict(zip(PARTS, parts, strict=True)) | {"time_d": F.to_date(day, "yyyy-MM-dd")})


def with_series(keys: DataFrame, page_map: DataFrame) -> DataFrame:
    """Key rows (with name, project, access, agent) and the ts_id of their page; every key row must have exactly one.

    Raises while the query runs if a key row finds no series; page_map has each page once.
    """
    both = keys.join(page_map.select("ts_id", *PARTS), list(PARTS), "left")
    found = F.when(F.col("ts_id").isNull(), F.raise_error(F.concat(F.lit("no series for page "), F.concat_ws("_", *PARTS)))).otherwise(F.col("ts_id"))
    return both.withColumn("ts_id", found)


def submission(forecasts: DataFrame, key: DataFrame) -> DataFrame:
    """Every row of the key (ts_id, time_d, Id) with its forecasts."""
    return forecasts.join(key, ["ts_id", "time_d"], "right")


def truth(solution: DataFrame, key: DataFrame) -> DataFrame:
    """ts_id, time_d, Visits by Id."""
    return solution.join(key, "Id").select("ts_id", "time_d", "Visits")


def score(forecasts: DataFrame, actual: DataFrame, columns: list[str], value: str = "Visits") -> DataFrame:
    """Final SMAPE of every model."""
    wide = forecasts.join(actual, ["ts_id", "time_d"]).agg(*[smape(F.col(c), F.col(value)).alias(c) for c in columns])
    return wide.unpivot([], columns, "model", "loss")
