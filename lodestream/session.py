"""Session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Adaptive execution re-plans partition counts and skewed joins from measured sizes; everything else is Spark's default.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "lodestream", cpus: int | None = None, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used as it is."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=SETTINGS)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions the cluster is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
