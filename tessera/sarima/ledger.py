"""Fits in chunks that survive their job: a restart fits only what is missing, and a retry adds nothing twice.

A folder holds `series` (the inputs with their chunk and task, written once), `fits/chunk=<k>` and `ledger/<k>`. A chunk's rows
are written to a folder of the attempt, counted against the chunk's series, moved in place and then entered in the ledger; a
chunk counts only once it is entered. What a broken attempt leaves behind is never read, and goes when its chunk is fitted anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .grouped import BOUNDS, SCHEMA, TASKS_A_CORE, Horizons, fit_planned, planned


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: object):
        return self._path("/".join([self.folder, *map(str, parts)]))

    def _exists(self, *parts: object) -> bool:
        return bool(self._fs.exists(self._at(*parts)))

    def open(self, stacked: DataFrame, params: DataFrame, chunks: int, most: tuple[int, int, int, int] = BOUNDS, tasks: int | None = None) -> None:
        """Writes the inputs and their plan, unless an earlier job did; then they must have the same series."""
        if not self._exists("series", "_SUCCESS"):
            each = tasks or TASKS_A_CORE * self.spark.sparkContext.defaultParallelism
            rows, total = planned(stacked, params, most, each * chunks)
            each = -(-total // chunks)  # bins of equal cost, so many to a chunk
            dealt = rows.withColumns({"chunk": F.floor(F.col("task") / each).cast("int"), "task": F.col("task") % each, "tasks": F.lit(each)})
            dealt.write.mode("overwrite").partitionBy("chunk").parquet(f"{self.folder}/series")
        keys = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("ts_id", "variable"))).first()
        if keys(stacked.select("ts_id", "variable").distinct()) != keys(self.series()):
            raise ValueError(f"{self.folder} was begun for other series")

    def series(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/series")

    def chunks(self) -> list[int]:
        found = self._fs.listStatus(self._at("series"))
        return sorted(int(x.getPath().getName().split("=")[1]) for x in found if x.getPath().getName().startswith("chunk="))

    def done(self) -> list[int]:
        return [k for k in self.chunks() if self._exists("ledger", k)]

    def run(self, horizons: Horizons, most: tuple[int, int, int, int] = BOUNDS, most_rounds: int = 1000) -> list[int]:
        """Fits the chunks that aren't entered yet; returns them."""
        missing = [k for k in self.chunks() if k not in set(self.done())]
        for k in missing:
            rows = self.series().where(F.col("chunk") == k)
            tasks = rows.select("tasks").first()[0]
            self.commit(k, fit_planned(rows, tasks, horizons, most, most_rounds), rows.count())
        return missing

    def commit(self, chunk: int, fitted: DataFrame, series: int) -> bool:
        """Enters a chunk once; False if it was entered before. All its series must be there."""
        if self._exists("ledger", chunk):
            return False
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        fitted.write.parquet(attempt)
        found = self.spark.read.schema(SCHEMA).parquet(attempt).select("ts_id", "variable").distinct().count()
        if found != series:
            raise RuntimeError(f"chunk {chunk} has {found} of {series} series")
        if self._exists("ledger", chunk):  # another job was faster
            self._fs.delete(self._path(attempt), True)
            return False
        self._fs.delete(self._at("fits", f"chunk={chunk}"), True)
        self._fs.mkdirs(self._at("fits"))
        if not self._fs.rename(self._path(attempt), self._at("fits", f"chunk={chunk}")):
            raise OSError(f"chunk {chunk} can't be moved in place")
        self._fs.mkdirs(self._at("ledger"))
        if not self._fs.createNewFile(self._at("ledger", chunk)):
            raise OSError(f"chunk {chunk} can't be entered")
        return True

    def fits(self) -> DataFrame:
        """The entered chunks' samples."""
        paths = [f"{self.folder}/fits/chunk={k}" for k in self.done()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*paths)


def fit_resumed(stacked: DataFrame, params: DataFrame, horizons: Horizons, folder: str, chunks: int = 16, most: tuple[int, int, int, int] = BOUNDS, most_rounds: int = 1000, tasks: int | None = None) -> DataFrame:
    """fit_variables() by way of a ledger in `folder`: called again after a crash, it goes on where that stopped."""
    ledger = Ledger(stacked.sparkSession, folder)
    ledger.open(stacked, params, chunks, most, tasks)
    ledger.run(horizons, most, most_rounds)
    return ledger.fits()
