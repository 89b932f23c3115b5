"""Session defaults for local runs; on a cluster the submitted configuration rules."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "riffle", cores: int | None = None) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and sizes that fit one machine."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
