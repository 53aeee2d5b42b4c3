"""Candidate ensembles, losses, ranks, weights and blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import finite_or_zero, mse, row_mean, row_median, smape

SMALL = 0.001


def pointwise(models: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ensmod_pointwise_mean and ensmod_pointwise_median over the columns that aren't NULL."""
    own = [F.col(c) for c in columns]
    return models.withColumns({"ensmod_pointwise_mean": row_mean(own), "ensmod_pointwise_median": row_median(own)})


def functionwise(models: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ensmod_funcwise_median: the column whose sum over the horizon is in the middle.

    Of an even number of models the sums at the two places after the middle are candidates, and that nearest to the mean of
    all sums wins (ties: by sum, then name); of an odd number the middle one.
    """
    n = len(columns)
    sums = models.groupBy("ts_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns])
    long = sums.unpivot(["ts_id"], columns, "model", "s")
    order = Window.partitionBy("ts_id").orderBy("s", "model")
    ranked = long.withColumns({"k": F.row_number().over(order), "mid": F.avg("s").over(Window.partitionBy("ts_id"))})
    places = [n // 2 + 1, n // 2 + 2] if n % 2 == 0 else [n // 2 + 1]
    chosen = ranked.where(F.col("k").isin(places)).groupBy("ts_id").agg(F.min_by("model", F.struct(F.abs(F.col("s") - F.col("mid")), "s", "model")).alias("chosen"))
    pick = F.coalesce(*[F.when(F.col("chosen") == c, F.col(c)) for c in columns])
    return models.join(chosen, "ts_id").withColumn("ensmod_funcwise_median", pick).drop("chosen")


def losses(models: DataFrame, actual: str, columns: list[str], keys: tuple[str, ...] = ("ts_id",), loss=smape) -> DataFrame:
    """keys, model, smape (or another loss): pairs that lack a value are left out one by one."""
    wide = models.groupBy(*keys).agg(*[loss(F.col(c), F.col(actual)).alias(c) for c in columns])
    return wide.unpivot(list(keys), columns, "model", "loss")


def complete_losses(models: DataFrame, actual: str, columns: list[str]) -> DataFrame:
    """Overall losses over the rows in which no model and no actual is missing."""
    return losses(models.dropna("any", subset=[actual, *columns]), actual, columns, ())


def mean_squared(models: DataFrame, actual: str, columns: list[str]) -> DataFrame:
    return losses(models, actual, columns, loss=mse)


def ranks(by_series: DataFrame) -> DataFrame:
    """model_rank from 1 within the series; NULL losses last, ties by name."""
    order = Window.partitionBy("ts_id").orderBy(F.col("loss").asc_nulls_last(), "model")
    return by_series.withColumn("model_rank", F.row_number().over(order))


def best_model(overall: DataFrame) -> DataFrame:
    return overall.where("loss is not null").agg(F.min_by("model", F.struct("loss", "model")).alias("model"), F.min("loss").alias("loss"))


def lengths_check(df: DataFrame) -> DataFrame:
    """Series that don't have as many rows as the longest; empty where all are equally long."""
    n = df.groupBy("ts_id").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.max("n").alias("most")))).where("n <> most")


def weights(by_series: DataFrame, k: int) -> DataFrame:
    """Long weights: 1 / (loss + SMALL) of the k best, normalised by series; equal weights if all losses are NULL."""
    whole = Window.partitionBy("ts_id")
    own = ranks(by_series).withColumn("w", F.when(F.col("model_rank") <= k, F.coalesce(1 / (F.col("loss") + SMALL), F.lit(0.0))).otherwise(F.lit(0.0)))
    none = F.count("loss").over(whole) == 0
    return own.select("ts_id", "model", F.when(none, F.lit(1.0) / F.count("*").over(whole)).otherwise(F.try_divide(F.col("w"), F.sum("w").over(whole))).alias("weight"))


def wide_weights(long: DataFrame, columns: list[str]) -> DataFrame:
    """ts_id and one column reWt_<model> for each model."""
    wide = long.groupBy("ts_id").pivot("model", columns).agg(F.first("weight"))
    return wide.select("ts_id", *[F.col(c).alias(f"reWt_{c}") for c in columns])


def blend(models: DataFrame, wide: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Sum of weight times prediction over models with a weight; missing predictions count as 0, without new weights."""
    total = F.lit(0.0)
    for c in columns:
        w = F.col(f"reWt_{c}")
        total = total + F.when(w != 0, w * finite_or_zero(F.col(c))).otherwise(F.lit(0.0))
    return models.join(wide, "ts_id").withColumn(name, total).drop(*[f"reWt_{c}" for c in columns])
