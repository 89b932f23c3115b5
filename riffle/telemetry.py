"""Seconds by phase of a run, and rows that pass through a plan, observed without another pass."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Telemetry:
    """Phases may repeat: their seconds add up. Rows of observed tables are there once an action has run over them."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self._observed: dict[str, Observation] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def observed(self, df: DataFrame, name: str) -> DataFrame:
        self._observed[name] = Observation(name)
        return df.observe(self._observed[name], F.count(F.lit(1)).alias("rows"))

    def rows(self, name: str) -> int:
        return self._observed[name].get["rows"]

    def frame(self, spark: SparkSession, run_id: str) -> DataFrame:
        return spark.createDataFrame([(run_id, n, s) for n, s in self.seconds.items()], "run_id string, phase string, seconds double")
