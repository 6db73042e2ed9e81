"""Sinks: what goes out, so that a repeated run leaves the same result."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import ranked


def partitioned(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Parquet below ``by=`` folders. Only the partitions that ``df`` has are replaced, so an hour that is run again isn't doubled;
    an empty ``df`` replaces none. Rows are rebalanced by partition value: small values share a task, a large one is split over several."""
    out = df.hint("rebalance", *[F.col(c) for c in by]).sortWithinPartitions(*by, *sort)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


class Throttled(Exception):
    """What ``send`` raises when it should be tried again later."""


def record_key(app: object, device: object, salt: int) -> str:
    """The key of a record in a keyed stream: the salt spreads one device over shards."""
    return hashlib.md5(f"{app}_{device}_{salt}".encode()).hexdigest()


def put(df: DataFrame, app: str, device: str, send: Callable[[list[tuple[str, str]]], list[int]], streams: int = 32, batch: int = 25, attempts: int = 5, wait: float = 1.0, pause: float = 0.0) -> None:
    """Each row as (key, JSON) to ``send`` in batches; ``send`` returns the numbers of the records it didn't take, and only those
    are sent again. Throttling backs off exponentially with jitter; other errors, and records still refused after ``attempts``, fail the task."""
    rows = df.select(F.col(app).alias("_a"), F.col(device).alias("_d"), F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("_j"))

    def one(part) -> None:
        held: list[tuple[str, str]] = []

        def flush() -> None:
            left = held[:]
            held.clear()
            for attempt in range(attempts):
                if not left:
                    break
                try:
                    left = [left[i] for i in send(left)]
                except Throttled:
                    if attempt == attempts - 1:
                        raise
                if left:
                    time.sleep(wait * 2**attempt + random.uniform(0.05, 0.25) * wait)
            if left:
                raise RuntimeError(f"{len(left)} records were refused {attempts} times")
            time.sleep(pause)

        for i, r in enumerate(part):
            held.append((record_key(r["_a"], r["_d"], i), r["_j"]))
            if len(held) == batch:
                flush()
        if held:
            flush()

    rows.repartition(streams).foreachPartition(one)


def batches(df: DataFrame, order: Sequence[Column], size: int = 1000, name: str = "events") -> DataFrame:
    """``batch, records, document``: rows in ``order``, ``size`` to a JSON document ``{name: [...]}``; null fields are left out.

    Positions come from a distributed sort; a list holds at most ``size`` rows.
    """
    rows = ranked(df, order, "_position").withColumn("batch", F.floor((F.col("_position") - 1) / size).cast("int"))
    records = F.sort_array(F.collect_list(F.struct("_position", F.struct(*df.columns).alias("r"))))
    grouped = rows.groupBy("batch").agg(F.count("*").alias("records"), records.alias("_l"))
    return grouped.select("batch", "records", F.to_json(F.struct(F.transform("_l", lambda x: x["r"]).alias(name))).alias("document"))


def log_run(df: DataFrame, path: str, run: str, params: dict[str, str]) -> None:
    """Metrics of a run (``df``: one row of numbers) appended to a table of runs."""
    stack = F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(c).cast("double") for c in df.columns])))
    rows = df.select(F.lit(run).alias("run"), F.lit(datetime.now(UTC).isoformat()).alias("at"), F.create_map(*[F.lit(x) for kv in params.items() for x in kv]).cast("map<string,string>").alias("params"), stack.alias("metric", "value"))
    rows.write.mode("append").parquet(path)
