"""Versioned snapshots: profiles and baselines that count only when complete and of the right version or digest."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotCache:
    """Tables by (repo, version) in a folder. A snapshot is written aside and renamed, so that a torn one is absent."""

    def __init__(self, spark: SparkSession, root: str, digest: str) -> None:
        self.spark, self.root, self.digest = spark, root.rstrip("/"), digest

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, repo: str, version: str) -> str:
        return f"{self.root}/{re.sub(r'[^A-Za-z0-9.-]', '_', repo)}/{version}-{self.digest}"

    def save(self, repo: str, version: str, df: DataFrame) -> str:
        to = self.path(repo, version)
        aside = f"{self.root}/.staging-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        fs, p = self._fs(to)
        fs.mkdirs(p.getParent())
        fs.delete(p, True)
        if not fs.rename(self._fs(aside)[1], p):
            raise OSError(f"could not move the snapshot to {to}")
        return to

    def load(self, repo: str, version: str) -> DataFrame | None:
        """The snapshot, or None if there is no complete one of this digest."""
        at = self.path(repo, version)
        fs, p = self._fs(f"{at}/_SUCCESS")
        return self.spark.read.parquet(at) if fs.exists(p) else None

    def latest(self, repo: str) -> str | None:
        """The version that was written last."""
        fs, p = self._fs(f"{self.root}/{re.sub(r'[^A-Za-z0-9.-]', '_', repo)}")
        if not fs.exists(p):
            return None
        done = [s for s in fs.listStatus(p) if s.getPath().getName().endswith(f"-{self.digest}")]
        newest = max(done, key=lambda s: (s.getModificationTime(), s.getPath().getName()), default=None)
        return None if newest is None else newest.getPath().getName().removesuffix(f"-{self.digest}")

    def invalidate(self, repo: str, version: str) -> None:
        fs, p = self._fs(self.path(repo, version))
        fs.delete(p, True)


def ledger_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """output, status: changed, missing or new, of published outputs against their sources (output, content)."""
    old = recorded.select("output", F.sha2(F.col("content").cast("binary"), 256).alias("old"))
    new = current.select("output", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("now"), "changed")
    return old.join(new, "output", "full").select("output", status.alias("status")).where("status is not null")
