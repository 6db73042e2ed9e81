"""Models by group as a table: registered run by run, looked up by the latest run of each group."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register(models: DataFrame, path: str, run: str | None = None) -> str:
    """Appends ``models`` (a group and ``model``) as one run below ``path``; runs are ordered by name, by default the time in UTC. Repeating a run replaces it."""
    run = run or datetime.now(UTC).strftime("%Y%m%dT%H%M%S.%f")
    models.write.mode("overwrite").parquet(f"{path}/run={run}")
    return run


def current(spark: SparkSession, path: str, group: str, upto: str | None = None) -> DataFrame:
    """``group, model, run``: each group's model of its latest run (not after ``upto``). Groups that a later run left out keep their older one."""
    runs = spark.read.option("recursiveFileLookup", "false").parquet(path).withColumn("run", F.col("run").cast("string"))
    if upto is not None:
        runs = runs.where(F.col("run") <= upto)
    latest = runs.groupBy(group).agg(F.max("run").alias("run"))  # names only: the models are read once, for the winners
    return runs.join(latest, [group, "run"]).select(group, "model", "run")
