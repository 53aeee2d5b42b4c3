"""Row numbers and quantiles of whole tables: ties, NULLs, one hot group, no task that sees it all."""

import random

import numpy as np
import pytest

from tessera.operators import ranking, stationarity, stats


def rows(n=2000):
    draw = random.Random(2)
    return [(draw.choice(["hot"] * 8 + ["a", None]), draw.choice([None, *[float(x) for x in range(-40, 40)], 1e9]), k) for k in range(n)]


def test_numbers_are_those_of_a_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, v double, k long").repartition(6)
    got = ranking.numbered(df, ["v", "k"], ("g",), size="n").collect()
    assert len(got) == len(data)
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [(r["v"], r["k"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [(v, k) for _, v, k in own]
        assert {r["n"] for r in got if r["g"] == g} == {len(own)}


def test_numbers_without_groups_and_of_nothing(spark):
    df = spark.range(100).repartition(5)
    assert [r["rank"] for r in ranking.numbered(df, ["id"]).orderBy("id").collect()] == list(range(100))
    assert ranking.numbered(df.where("id < 0"), ["id"]).count() == 0


@pytest.mark.parametrize("shares", [[0.25, 0.5, 0.75], [0.0, 0.1, 0.333, 1.0]])
def test_quantiles_are_exact(spark, shares):
    data = [r for r in rows() if r[0] is not None]
    df = spark.createDataFrame(data, "g string, v double, k long").repartition(6)
    got = {r["g"]: r["q"] for r in ranking.quantiles(df, "v", shares, ("g",)).collect()}
    for g in ("hot", "a"):
        assert got[g] == pytest.approx(np.quantile([v for x, v, _ in data if x == g and v is not None], shares).tolist())
    (whole,) = ranking.quantiles(df, "v", shares).collect()
    assert whole["q"] == pytest.approx(np.quantile([v for _, v, _ in data if v is not None], shares).tolist())


def test_describe_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0), ("b", 4.0), (None, 7.0)], "g string, v double")
    got = {r["g"]: r for r in stats.describe(df, ["v"], ("g",)).collect()}
    assert got["a"]["count"] == 0 and got["a"]["p50"] is None
    assert (got["b"]["p25"], got["b"]["p50"], got["b"]["p75"]) == (1.5, 2.0, 3.0) and got[None]["p50"] == 7.0


def test_no_task_sees_all_values(spark):
    """Values in different places of the order are in different partitions of the written table."""
    from pyspark.sql import functions as F

    df = spark.range(0, 4000).select(F.lit("hot").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("__times"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.repartitionByRange("g", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 4000


def test_kpss_has_one_shuffle_by_series_and_no_lambda(spark):
    df = spark.createDataFrame([(f"s{k % 3}", k, float(k % 7)) for k in range(90)], "ts_id string, time_d int, x double")
    plan = stationarity.attempts(df, "x", 7)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("Exchange hashpartitioning(") == 1
