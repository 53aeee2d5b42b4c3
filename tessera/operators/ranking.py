"""Row numbers and exact quantiles of whole tables without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def numbered(df: DataFrame, order: list[str], by: tuple[str, ...] = (), to: str = "rank", size: str | None = None) -> DataFrame:
    """df with the row's number (from 0) in the given order, within the groups `by`; size: a column for the group's rows.

    Rows are range-partitioned by group and order and numbered within their partition; the partitions' counts, one row for each
    partition and group, give what comes before. A group of any size is spread over partitions. Ties are numbered in any order.
    """
    keys = [*by, *order]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed, _ = materialize(parts.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "placed")
    runs = placed.groupBy(*by, "__part").agg(F.min("__place").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__run"), (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("__size"))
    same = placed["__part"] == runs["__run"]
    for b in by:
        same = same & placed[b].eqNullSafe(runs[f"__{b}"])
    out = placed.join(runs, same).withColumn(to, F.col("__place") + F.col("__shift"))
    if size:
        out = out.withColumn(size, F.col("__size"))
    return out.drop("__part", "__place", "__run", "__shift", "__size", *[f"__{b}" for b in by])


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact interpolated quantiles (as percentile()) of each group: by, and an array q in the order of shares; NULLs don't count.

    The values' numbers come from numbered(); of a group only the two rows around each share's place go on. No task sees a whole
    group, and equal values are combined before they are sorted.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__times"))
    heads = numbered_weighted(own, value, by)
    place = lambda s: F.lit(s) * (F.col("__n") - 1)
    inside = lambda at: (F.col("__from") <= at) & (at < F.col("__from") + F.col("__times"))
    ends = []
    for k, s in enumerate(shares):
        low, high = F.floor(place(s)), F.ceil(place(s))
        ends += [F.max(F.when(inside(low), F.col(value))).alias(f"__l{k}"), F.max(F.when(inside(high), F.col(value))).alias(f"__h{k}")]
    near = F.lit(False)
    for s in shares:
        near = near | inside(F.floor(place(s))) | inside(F.ceil(place(s)))
    found = heads.where(near).groupBy(*by).agg(F.max("__n").alias("__n"), *ends)
    mixed = [F.col(f"__l{k}") + (place(s) - F.floor(place(s))) * (F.col(f"__h{k}") - F.col(f"__l{k}")) for k, s in enumerate(shares)]
    return found.select(*by, F.array(*mixed).alias("q"))


def numbered_weighted(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """df (by, value, __times) with __from, the number of values before, and __n, those of the group."""
    keys = [*by, value]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed, _ = materialize(parts.withColumn("__part", F.spark_partition_id()), "values")
    whole = Window.partitionBy(*[f"__{b}" for b in by])
    runs = placed.groupBy("__part", *[F.col(b).alias(f"__{b}") for b in by]).agg(F.sum("__times").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[f"__{b}" for b in by], F.col("__part").alias("__run"), before.alias("__before"), F.sum("__rows").over(whole).alias("__n"))
    inside: Column = F.sum("__times").over(Window.partitionBy("__part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    same = placed["__part"] == runs["__run"]
    for b in by:
        same = same & placed[b].eqNullSafe(runs[f"__{b}"])
    own = placed.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    return own.join(runs, same).withColumn("__from", F.col("__before") + F.col("__inside")).drop("__part", "__run", "__before", "__inside", *[f"__{b}" for b in by])
