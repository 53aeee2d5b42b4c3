"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster can't have one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> None:
    """Has a folder that is there deleted when the application ends; later results may still read it until then."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class CheckFailed(RuntimeError):
    """A table broke one of its checks and wasn't kept."""


def observed(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """df with the checks (aggregates over all its rows that must be true) as metrics of whatever job runs it."""
    seen = Observation()
    return df.observe(seen, *[F.coalesce(c, F.lit(True)).alias(name) for name, c in checks.items()]), seen


def verify(seen: Observation, name: str) -> None:
    broken = [check for check, held in seen.get.items() if not held]
    if broken:
        raise CheckFailed(f"{name}: {', '.join(broken)}")


def materialize(df: DataFrame, name: str, checks: dict[str, Column] | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors.

    checks are looked at in the pass that writes; where one fails the table goes and CheckFailed is raised.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if checks:
        df, seen = observed(df, checks)
    df.write.parquet(path)
    temporary(spark, path)
    if checks:
        try:
            verify(seen, name)
        except CheckFailed:
            remove(spark, path)
            raise
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, by: str = "ts_id", buckets: int | None = None, checks: dict[str, Column] | None = None) -> DataFrame:
    """As materialize(), in buckets of a key and sorted by it: such tables join and group by the key without a shuffle.

    Tables that are to be joined need the same number of buckets; the default is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = fresh_path(spark, name), f"tessera_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, by)
    if checks:
        dealt, seen = observed(dealt, checks)
    dealt.write.format("parquet").bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
    temporary(spark, path)
    if checks:
        try:
            verify(seen, name)
        except CheckFailed:
            spark.sql(f"DROP TABLE {table}")
            remove(spark, path)
            raise
    return spark.table(table)
