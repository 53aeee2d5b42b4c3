import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import panel
from tessera.sources import files
from tessera.streaming.weekly import weekly_stream


def test_wide_csv_to_long(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Page,2024-01-01,2024-01-02\nA_en_all_spider,3,\nB_en_all_spider,,4\n")
    long = panel.wide_to_long(files.wide_csv(spark, str(tmp_path / "wide.csv")), ["Page"], "x")
    assert {(r["Page"][0], r["time_d"].day, r["x"]) for r in long.collect()} == {("A", 1, 3.0), ("A", 2, None), ("B", 1, None), ("B", 2, 4.0)}


def test_key_truth_and_gzip(spark, tmp_path):
    df = spark.createDataFrame([("a_2024-01-01", "x1")], "Page string, Id string")
    files.write_csv(df, str(tmp_path / "key"), gzip=True)
    assert list((tmp_path / "key").glob("*.csv.gz"))
    assert files.key_csv(spark, str(tmp_path / "key")).collect() == df.collect()
    files.write_csv(spark.createDataFrame([("x1", 2.0)], "Id string, Visits double"), str(tmp_path / "truth"))
    assert files.truth_csv(spark, str(tmp_path / "truth")).first()["Visits"] == 2.0


def test_table_store(spark, tmp_path):
    store = files.TableStore(spark, str(tmp_path))
    df = spark.range(10).select(F.col("id").alias("ts_id"), F.lit(dt.date(2024, 1, 3)).alias("time_d"))
    store.put("t", df, sort=("ts_id",))
    store.append("t", df)
    assert store.count("t") == 20 and store.last_date("t") == dt.date(2024, 1, 3) and store.preview("t", 3).count() == 3
    assert store.get("t", ["ts_id"], "ts_id = 4").count() == 2
    store.rename("t", "u")
    assert store.exists("u") and not store.exists("t")
    store.drop("u")
    assert not store.exists("u")


def test_weekly_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(str(tmp_path / "in"))
    q = weekly_stream(stream, "event_type").writeStream.format("memory").queryName("weekly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["event_type"], r["time_w"], r["n"]) for r in df.collect())
    assert key(spark.table("weekly")) == key(weekly_stream(spark.read.parquet(source), "event_type"))


def test_append_keeps_the_layout(spark, tmp_path):
    store = files.TableStore(spark, str(tmp_path))
    df = spark.range(6).select("id", (F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b"))
    store.put("t", df, partition=("a", "b"))
    store.append("t", df)
    assert store.partitions("t") == ["a", "b"] and store.count("t") == 12 and store.get("t", where="a = 1 and b = 2").count() == 2
    assert not list((tmp_path / "t").glob("*.parquet"))


def test_rename_replaces_only_a_whole_table(spark, tmp_path):
    import pytest

    store = files.TableStore(spark, str(tmp_path))
    store.put("a", spark.range(3))
    store.put("b", spark.range(5))
    with pytest.raises(FileNotFoundError):
        store.rename("c", "b")
    assert store.count("b") == 5
    store.rename("a", "b")
    assert store.count("b") == 3 and not store.exists("a") and not store.exists("b.replaced")


def test_weeks_don_t_follow_the_session_zone(spark):
    events = spark.sql("SELECT 'x' AS event_type, timestamp_ntz'2024-01-01 00:30:00' + make_interval(0, 0, 0, k) AS ts, 1.0D AS value FROM (SELECT explode(sequence(0, 13)) AS k)")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        got = sorted((str(r["time_w"]), r["n"]) for r in weekly_stream(events, "event_type").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [("2024-01-07", 7), ("2024-01-14", 7)]


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from tessera import storage

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        storage.shared_base(type("Session", (), {"sparkContext": Context})())
