"""Structured Streaming over arriving findings: an extension. Scoping and deduplication of each batch equal the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from riffle.operators.findings import scope


def first_seen(findings: DataFrame, time: str, delay: str = "1 hour", keys: tuple[str, ...] = ("run_id", "fingerprint")) -> DataFrame:
    """Each key once within the watermark's delay; state older than that is dropped."""
    return findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def scoped_stream(findings: DataFrame, baseline: DataFrame, covered: DataFrame, spans: DataFrame, known: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Scope each micro-batch against the tables and hand it to sink(batch, batch_id), which has to be idempotent by id."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(scope(batch, baseline, covered, spans, known), batch_id)

    return findings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch under its id, replacing what a failed attempt left."""
    return lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
