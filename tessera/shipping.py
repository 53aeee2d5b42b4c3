"""Makes the library importable on executors whose Python path doesn't have it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SENT: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Adds the package as a zip to the application, once; nothing to do where PYTHONPATH names its folder."""
    app = spark.sparkContext.applicationId
    if app in _SENT or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp()) / "tessera-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "tessera").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure(spark)
        return query(spark, sf_dir)

    return run
