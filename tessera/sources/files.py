"""CSV and Parquet sources and sinks of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.ranking import numbered
from ..storage import CheckFailed, observed, verify


def wide_csv(spark: SparkSession, path: str, ids: tuple[str, ...] = ("Page",)) -> DataFrame:
    """A wide panel: id columns as strings, date-named columns as doubles. Only the header is read to learn the names."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType() if c in ids else T.DoubleType()) for c in header])
    return spark.read.option("header", True).schema(schema).csv(path)


def key_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Page string, Id string").csv(path)


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Id string, Visits double").csv(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


#: Column of the row's place in tables that are written in an order.
ROW = "__row"


class TableStore:
    """Named Parquet tables in one folder.

    put(order=...) keeps the rows in a global order and numbers them, so that slice() reads a range of rows; put(index=...) adds
    bloom filters, so that a filter on such a column reads the row groups that may hold the value, wherever files overlap.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _writer(self, df: DataFrame, index: tuple[str, ...]):
        writer = df.write.option("compression", "zstd")
        for c in index:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        return writer

    def put(self, name: str, df: DataFrame, sort: tuple[str, ...] = (), partition: tuple[str, ...] = (), order: tuple[str, ...] = (), index: tuple[str, ...] = (), checks: dict[str, Column] | None = None, rows_a_group: int | None = None) -> None:
        """Overwrites the table, once the new one is whole and passes its checks (aggregates that must be true).

        sort: within files; order: over the whole table; rows_a_group: rows of a row group at most, else by bytes.
        """
        if order:
            numbers = numbered(df, list(order), to=ROW)
            df = numbers.repartitionByRange(ROW).sortWithinPartitions(ROW)
        elif sort:
            df = df.sortWithinPartitions(*sort)
        new = f"{name}.new"
        if checks:
            df, seen = observed(df, checks)
        writer = self._writer(df, index)
        if rows_a_group:
            writer = writer.option("parquet.block.row.count.limit", str(rows_a_group)).option("parquet.page.row.count.limit", str(rows_a_group))
        writer.mode("overwrite").partitionBy(*partition).parquet(self.path(new))
        if checks:
            try:
                verify(seen, name)
            except CheckFailed:
                self.drop(new)
                raise
        self.rename(new, name)

    def replace(self, name: str, df: DataFrame) -> None:
        """Overwrites those partitions of the table that df has rows of, and no others."""
        by = self.partitions(name)
        if not by:
            raise ValueError(f"{name} has no partitions")
        self._writer(df, ()).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(name))

    def partitions(self, name: str) -> list[str]:
        """Columns that the table's folders are named by."""
        fs, path = self._fs()
        out, where = [], self.path(name)
        while fs.exists(path(where)):
            inside = [x.getPath().getName() for x in fs.listStatus(path(where)) if x.isDirectory() and "=" in x.getPath().getName()]
            if not inside:
                break
            out.append(inside[0].split("=")[0])
            where = f"{where}/{inside[0]}"
        return out

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows, in the folders that put() laid out."""
        df.write.mode("append").option("compression", "zstd").partitionBy(*self.partitions(name)).parquet(self.path(name))

    def get(self, name: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
        """Columns and filters reach the scan."""
        df = self.spark.read.parquet(self.path(name))
        df = df.where(where) if where else df
        return df.select(*columns) if columns is not None else df.drop(ROW)

    def preview(self, name: str, n: int = 10) -> DataFrame:
        return self.get(name).limit(n)

    def last_date(self, name: str, time: str = "time_d"):
        return self.get(name).agg(F.max(time)).first()[0]

    def footers(self, name: str) -> list[tuple[str, list[int]]]:
        """Files of the table in the order of their names and the rows of each of their row groups, from the footers alone."""
        fs, path = self._fs()
        conf, jvm = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm
        files, found = jvm.java.util.ArrayList(), fs.listFiles(path(self.path(name)), True)
        while found.hasNext():
            status = found.next()
            if status.getPath().getName().endswith(".parquet"):
                files.add(status)
        out = []
        for footer in jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(conf, files, False):
            blocks = footer.getParquetMetadata().getBlocks()
            out.append((footer.getFile().toString(), [blocks.get(k).getRowCount() for k in range(blocks.size())]))
        return sorted(out)

    def count(self, name: str) -> int:
        """Rows of the table; no data page is read."""
        return sum(sum(groups) for _, groups in self.footers(name))

    def slice(self, name: str, start: int, stop: int) -> DataFrame:
        """Rows start to stop - 1 of a table that put() wrote in an order, in that order.

        The footers say which files hold them; in these the rows' numbers leave only the row groups that are needed.
        """
        at, files = 0, []
        for file, groups in self.footers(name):
            if at < stop and start < at + sum(groups):
                files.append(file)
            at += sum(groups)
        if not files:
            return self.spark.read.parquet(self.path(name)).where("false").drop(ROW)
        rows = self.spark.read.parquet(*files)
        return rows.where(F.col(ROW).between(start, stop - 1)).orderBy(ROW).drop(ROW)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self, name: str) -> bool:
        fs, path = self._fs()
        return bool(fs.exists(path(self.path(name))))

    def drop(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path(name)), True)

    def rename(self, old: str, new: str) -> None:
        """A table named new goes only once the other has its name."""
        if not self.exists(old):
            raise FileNotFoundError(old)
        fs, path = self._fs()
        aside = f"{new}.replaced"
        if self.exists(new) and not fs.rename(path(self.path(new)), path(self.path(aside))):
            raise OSError(f"{new} can't be moved")
        if not fs.rename(path(self.path(old)), path(self.path(new))):
            if self.exists(aside):
                fs.rename(path(self.path(aside)), path(self.path(new)))
            raise OSError(f"{old} can't be renamed")
        self.drop(aside)
