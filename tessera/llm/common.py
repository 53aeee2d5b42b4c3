"""Shared helpers of the training-data operators: bounded Arrow batches, files, words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import fresh_path, materialize, remove, shared_base, temporary  # noqa: F401  the operators take them from here

#: A word is a run of anything but ASCII blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows and bytes that one Arrow batch may hold; very long texts then can't pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = "500", str(16 << 20)


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Other rows in a batch for what runs inside: tables of many short rows."""
    bounded_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        bounded_batches(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def py_crc_mod(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


class Memo(dict):
    """A bounded memo of make(key): once it holds `most` entries they become the old generation, and the older one goes.

    Keys over `longest` characters are made anew each time.
    """

    def __init__(self, make: Callable, most: int, longest: int = 0):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.make(key)
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_OWN: dict = {}


def worker_cache(key, make: Callable):
    """make() once in a worker process; what another operator kept there before goes."""
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = make()
    return _OWN[key]


def release() -> None:
    """Gives back what this worker keeps from earlier tasks: another operator's cache, Arrow's and the C library's free memory."""
    import ctypes

    import pyarrow as pa

    _OWN.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def filesystem(url: str):
    """(pyarrow filesystem, path) of a URL; local paths need no scheme."""
    from pyarrow import fs

    if url.startswith("file:") or "://" not in url:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", url)
    return fs.FileSystem.from_uri(url)
