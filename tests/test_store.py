"""Row ranges, counts, indexes, partitions, buckets and checks of stored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import checks
from tessera.sources import files


def scanned(spark, make) -> int:
    """Rows that the scans of make() give to its plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = make()._jdf.queryExecution().executedPlan()
        plan.executeCollectPublic()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.fixture
def store(spark, tmp_path):
    return files.TableStore(spark, str(tmp_path))


def shuffled(spark, n=6000):
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("ts_id"), F.lit("x").alias("v")).repartition(4)


def test_a_row_range_reads_its_groups_only(spark, store):
    store.put("t", shuffled(spark), order=("ts_id",), rows_a_group=500)
    assert store.get("t").columns == ["ts_id", "v"] and store.count("t") == 6000
    part = store.slice("t", 1234, 1300)
    assert [r["ts_id"] for r in part.collect()] == list(range(1234, 1300))
    assert scanned(spark, lambda: store.slice("t", 1234, 1300)) <= 1000
    assert [r["ts_id"] for r in store.slice("t", 5990, 9999).collect()] == list(range(5990, 6000))
    assert store.slice("t", 6000, 7000).count() == 0 and store.slice("t", 0, 6000).count() == 6000


def test_counts_come_from_footers(spark, store, monkeypatch):
    store.put("t", shuffled(spark), partition=("v",), rows_a_group=100)
    store.append("t", shuffled(spark, 10))
    monkeypatch.setattr(files.TableStore, "get", lambda *a, **k: pytest.fail("the table was read"))
    assert store.count("t") == 6010
    assert sum(len(groups) for _, groups in store.footers("t")) >= 60


def test_an_index_leaves_the_groups_of_other_series(spark, store):
    """Series dealt over all files and groups, so that minima and maxima don't tell them apart."""
    df = spark.range(8000).select(((F.col("id") * 7919) % 8000).alias("ts_id"), F.col("id").alias("v")).repartition(8)
    store.put("plain", df, rows_a_group=500)
    store.put("indexed", df, index=("ts_id",), rows_a_group=500)
    one = lambda name: store.get(name, where="ts_id = 4321")
    assert one("indexed").count() == 1 == one("plain").count()
    assert scanned(spark, lambda: one("plain")) > 6000 and scanned(spark, lambda: one("indexed")) <= 1500


def test_one_sample_is_replaced(spark, store, tmp_path):
    df = spark.range(30).select("id", F.element_at(F.array(F.lit("fitted"), F.lit("valicast"), F.lit("forecast")), (F.col("id") % 3 + 1).cast("int")).alias("sample"))
    store.put("fits", df, partition=("sample",))
    seen = lambda s: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "fits" / f"sample={s}").glob("*.parquet"))
    before = {s: seen(s) for s in ("fitted", "valicast", "forecast")}
    store.replace("fits", spark.createDataFrame([(100, "valicast"), (101, "valicast")], "id long, sample string"))
    assert seen("fitted") == before["fitted"] and seen("forecast") == before["forecast"] and seen("valicast") != before["valicast"]
    assert sorted(r["id"] for r in store.get("fits", where="sample = 'valicast'").collect()) == [100, 101] and store.count("fits") == 22
    store.put("whole", df)
    with pytest.raises(ValueError, match="no partitions"):
        store.replace("whole", df)


def test_a_failed_check_leaves_the_old_table(spark, store):
    store.put("t", spark.range(5), checks=checks.rows(5))
    with pytest.raises(storage.CheckFailed, match="6 rows"):
        store.put("t", spark.range(7), checks=checks.rows(6))
    assert store.count("t") == 5 and not store.exists("t.new")


def test_each_check_fires_in_the_pass_that_writes(spark):
    left = spark.range(10).withColumnRenamed("id", "ts_id")
    right = spark.range(8).select(F.col("id").alias("ts_id"), F.lit(1.0).alias("actual"))
    kept, path = storage.materialize(left.join(right, "ts_id", "left"), "joined", checks.rows(10))
    assert kept.count() == 10
    with pytest.raises(storage.CheckFailed, match="10 rows"):
        storage.materialize(left.join(right, "ts_id"), "joined", checks.rows(10))
    with pytest.raises(storage.CheckFailed, match="actual complete"):
        storage.materialize(left.join(right, "ts_id", "left"), "joined", checks.complete("actual"))
    plugged = spark.createDataFrame([(1.0, None), (None, None)], "plug double, model double").withColumn("model", F.lit(None).cast("double"))
    with pytest.raises(storage.CheckFailed, match="model complete where plug is"):
        storage.materialize(plugged, "plugged", checks.complete_where("model", "plug"))
    shares = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 0.4), ("b", 0.5)], "grp string, share double")
    total = lambda df: df.withColumn("total", checks.group_total("share", "grp"))
    storage.materialize(total(shares.where("grp = 'a'")), "shares", checks.adds_up("total"))
    with pytest.raises(storage.CheckFailed, match="total adds up"):
        storage.bucketed(total(shares), "shares", "grp", 2, checks.adds_up("total"))


def test_a_check_needs_no_scan_of_its_own(spark):
    source = spark.range(100).repartition(2)
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    counted = source.mapInArrow(count, "id long")
    storage.materialize(counted, "once", {**checks.rows(100), **checks.complete("id")})
    assert ran.value == 100


def test_buckets_join_and_group_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = storage.bucketed(spark.range(500).select((F.col("id") % 50).alias("ts_id"), F.col("id").alias("x")), "a", buckets=4)
        b = storage.bucketed(spark.range(50).select(F.col("id").alias("ts_id"), (F.col("id") * 2).alias("y")), "b", buckets=4)
        both = a.join(b, "ts_id").groupBy("ts_id").agg(F.sum("x").alias("x"), F.max("y").alias("y"))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and both.count() == 50
        one = lambda: a.where("ts_id = 7")
        assert one().count() == 10 and scanned(spark, one) < 250  # one bucket of four
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables_pass_their_checks(spark):
    none = spark.createDataFrame([], "grp string, share double").withColumn("total", checks.group_total("share", "grp"))
    kept, _ = storage.materialize(none, "none", {**checks.rows(0), **checks.adds_up("total")})
    assert kept.count() == 0
