"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under the warehouse. Removed when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/lineweave-{label}-{uuid.uuid4().hex}"
    _hadoop(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes inside are deleted at the end, but for those written to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _hadoop(spark, path, lambda fs, p: fs.delete(p, True))


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written once as Parquet and read again: its lineage ends there, and a lost executor costs no recomputation.

    keep: it outlives the innermost `scratch`, and goes with the one around that."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    df.write.parquet(path)
    # Spark removes the shuffle files of plans that nothing refers to when the driver's JVM collects garbage
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `stored` wrote, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _hadoop(df.sparkSession, folder, lambda fs, p: fs.delete(p, True))


def _hadoop(spark: SparkSession, path: str, call) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    call(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the workers of the session, which may run where it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lineweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp()  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/lineweave_source.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "lineweave").rglob("*.py")):
            out.write(f, f.relative_to(root))
    sc.addPyFile(archive)
    sc._lineweave_shipped = True
