"""Tables in the folder that driver and executors share: they cut the lineage of loops and stages, and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RECORDS: list[list[str]] = []
_CLEANED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; where neither is set, a local folder under a local master.

    On a cluster a folder of one machine would lose data without an error, so that there it has to be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = at.get() if at.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="riffle-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/riffle/{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_clean, spark, path)
    return path


def _clean(spark: SparkSession, path: str) -> None:
    try:
        discard(spark, path)
    except Exception:  # noqa: BLE001, S110  the JVM may be gone already; then the folder stays for whoever owns it
        pass


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again; the path too, for discard()."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for record in _RECORDS:
        record.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that materialize() wrote and nothing reads any longer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Paths of the tables that are materialized meanwhile."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS.remove(record)
