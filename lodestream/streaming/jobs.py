"""Streams: hourly windows with late data, statistics kept per device, and the same sinks as in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.scratch import root
from lodestream.sources import sinks

KEYS = ["app_id", "device_id", "event_date", "record_type", "session_id"]
#: Shares of a device's state, so that a busy device is kept by several tasks.
SALTS = 8
#: Repeats arrive up to two days late; rows may come in any order inside it.
LATE = "72 hours"


def opened(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream over the folder or single file at ``path``, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, since a plain path has to be a folder


def deduplicated(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, however often it arrives within ``late``. The time is read in UTC."""
    return stream.withColumn("at", F.col("event_date").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(KEYS)


def hourly(stream: DataFrame) -> DataFrame:
    """``app_id, window, events, usage`` in tumbling hours: partial sums before the shuffle, so a busy app is no bottleneck."""
    usage = F.coalesce(F.col("input_bytes") + F.col("output_bytes"), F.lit(0))
    return stream.groupBy("app_id", F.window("at", "1 hour")).agg(F.count("*").alias("events"), F.sum(usage).alias("usage"))


def _kept(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Counts, means and squared deviations, merged with those of earlier batches by Chan's formula."""
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    for b in batches:
        x = b["session_time"].dropna()
        if len(x):
            d, k = x.mean() - mean, len(x)
            m2 += float(((x - x.mean()) ** 2).sum()) + d * d * n * k / (n + k)
            mean += d * k / (n + k)
            n += k
    state.update((n, float(mean), float(m2)))
    yield pd.DataFrame({"device_id": [key[0]], "salt": [key[1]], "n": [n], "mean": [float(mean)], "m2": [float(m2)]})


def statistics(stream: DataFrame) -> DataFrame:
    """Running ``n, mean, m2`` of the session time per device and salt; :func:`combined` adds the salts up. Null devices are left out."""
    rows = stream.where("device_id IS NOT NULL").select("device_id", F.when(~F.isnan("session_time"), F.col("session_time")).alias("session_time"), F.pmod(F.xxhash64(*KEYS), F.lit(SALTS)).cast("int").alias("salt"))
    out, kept = "device_id long, salt int, n long, mean double, m2 double", "n long, mean double, m2 double"
    return rows.groupBy("device_id", "salt").applyInPandasWithState(_kept, out, kept, "update", "NoTimeout")


def combined(parts: DataFrame) -> DataFrame:
    """``device_id, n, mean, std`` from the salted statistics."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    rows = parts.where("n > 0").groupBy("device_id").agg(n.alias("n"), (total / n).alias("mean"), F.sum("m2").alias("_w"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("n") * F.col("mean") * F.col("mean"))
    return rows.select("device_id", "n", "mean", F.sqrt((F.col("_w") + spread) / F.col("n")).alias("std"))


def _window(many: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).drop_duplicates("key").sort_values(["t", "key"])  # one source's rows of one micro-batch
        rolling = []
        for x in rows["x"].astype(float).tolist():
            last = [*last, x][-many:]
            some = [v for v in last if v == v and v != 0]
            rolling.append(sum(some) / len(some) if some else 0.0)
        state.update((last[1 - many :],))
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "rolling": rolling})

    return run


def rolling(stream: DataFrame, key: str, source: str, t: str, x: str, many: int = 8) -> DataFrame:
    """``key, rolling``: the mean of a source's last ``many`` values that aren't null or 0, the row's own included; 0 where there is none.

    The last ``many`` - 1 values of each source are the state, so no output is read again. Rows come in the order of ``t`` from batch to batch, in
    any order inside one; repeats of a key in a batch count once. Rows without a source are left out.
    """
    rows = stream.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.col(key).cast("long").alias("key"), F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x"))
    out = rows.groupBy("source").applyInPandasWithState(_window(many), "key long, rolling double", "last array<double>", "append", "NoTimeout")
    return out.withColumnRenamed("key", key)


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``score`` makes of each micro-batch, written batch by batch (a repeated batch replaces itself)."""
    spark = stream.sparkSession
    path = f"{root(spark)}/scored-{uuid4().hex[:12]}"
    drained(stream, lambda df, i: score(df).write.mode("overwrite").parquet(f"{path}/batch={i}"), "append")
    return spark.read.parquet(path).drop("batch")


def sent(stream: DataFrame, app: str, device: str, client: Callable, **settings) -> None:
    """Every micro-batch handed to :func:`lodestream.sources.sinks.put`, which sends in batches and retries what was refused."""
    drained(stream, lambda df, i: sinks.put(df, app, device, client, **settings), "append")


def drained(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs over what is there and stops; progress is kept in the shared folder."""
    at = f"{root(stream.sparkSession)}/stream-{uuid4().hex[:12]}"
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()


def table_of(stream: DataFrame, mode: str = "update") -> DataFrame:
    """The rows that a drained stream has written, with the number of the batch (``_batch``) that wrote each."""
    spark = stream.sparkSession
    path = f"{root(spark)}/streamed-{uuid4().hex[:12]}"
    drained(stream, lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/batch={i}"), mode)
    return spark.read.parquet(path).drop("batch")
