"""Per-key work spread evenly when a few keys hold most rows: fragment-replicate by load.

1. Loads: rows per key, counted with map-side combine.
2. Plan: keys above ``split`` of a task's fair load are cut into proportionate shards; every other key falls
   into one of a fixed number of hash buckets. Shards and buckets are packed onto tasks, largest first, always
   onto the least loaded task.
3. Fragments: each row gets its task, a split key's rows are dealt over its shards, and rows move by task
   number (not by a hash of it, so packing is kept).
4. The matching side is replicated, but only to the tasks that hold a shard of the key.

The driver sees the split keys (at most ``tasks / split``) and the buckets (``tasks * BUCKETS``), never the keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.ordered import same
from lodestream.scratch import written
from lodestream.session import tasks as default_tasks

TASK = "__lode_task"
BUCKETS = 16
#: Split keys go to the cluster as a broadcast table of at most tasks / split rows; this is the default share.
SPLIT = 0.25


@dataclass(frozen=True)
class Plan:
    """Where the rows of each key go."""

    key: str
    tasks: int
    heavy: DataFrame  # key, _tasks: the tasks of the key's shards
    buckets: DataFrame  # the task of each hash bucket
    loads: tuple[float, ...]  # planned rows per task
    rows: int


def pack(weights: Sequence[float], tasks: int) -> tuple[list[int], list[float]]:
    """A task for each weight, largest first onto the least loaded task; and the loads."""
    heap = [(0.0, t) for t in range(tasks)]
    at, loads = [0] * len(weights), [0.0] * tasks
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        load, t = heapq.heappop(heap)
        at[i], loads[t] = t, load + weights[i]
        heapq.heappush(heap, (loads[t], t))
    return at, loads


def plan(df: DataFrame, key: str, tasks: int | None = None, split: float = SPLIT) -> Plan:
    """Shards, buckets and tasks for the rows of ``df`` by ``key``. Null is a key like any other."""
    spark, n = df.sparkSession, tasks or default_tasks(df.sparkSession)
    loads = written(df.groupBy(key).agg(F.count("*").alias("__lode_rows")), "loads")
    rows = loads.agg(F.coalesce(F.sum("__lode_rows"), F.lit(0))).first()[0]
    limit = max(1.0, split * rows / n)
    large = loads.where(F.col("__lode_rows") > limit).collect()  # fewer than tasks / split
    bucket = F.pmod(F.hash(key), F.lit(n * BUCKETS)).alias("__lode_bucket")
    small = loads.where(F.col("__lode_rows") <= limit).groupBy(bucket).agg(F.sum("__lode_rows").alias("__lode_rows")).collect()  # at most tasks * BUCKETS
    weights, owner = [0.0] * (n * BUCKETS), []
    for r in small:
        weights[r["__lode_bucket"]] = float(r["__lode_rows"])
    for i, r in enumerate(large):
        shards = min(n, -(-r["__lode_rows"] // int(max(1, limit))))
        weights += [r["__lode_rows"] / shards] * shards
        owner += [i] * shards
    at, planned = pack(weights, n)
    places: list[list[int]] = [[] for _ in large]
    for i, t in zip(owner, at[n * BUCKETS :], strict=True):
        places[i].append(t)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("__lode_tasks", T.ArrayType(T.IntegerType()))])
    heavy = spark.createDataFrame([(r[key], p) for r, p in zip(large, places, strict=True)], schema)
    buckets = spark.createDataFrame(list(enumerate(at[: n * BUCKETS])), "__lode_bucket int, __lode_owner int")
    return Plan(key, n, heavy, buckets, tuple(planned), rows)


def _placed(rows: DataFrame, p: Plan) -> DataFrame:
    """``rows`` with the tasks of a split key's shards (null for other keys) and the task of the key's bucket."""
    heavy = F.broadcast(p.heavy.withColumnRenamed(p.key, "__lode_heavy"))  # at most tasks / split rows
    buckets = F.broadcast(p.buckets)  # tasks * BUCKETS rows
    rows = rows.join(heavy, rows[p.key].eqNullSafe(heavy["__lode_heavy"]), "left").drop("__lode_heavy")
    at = F.pmod(F.hash(p.key), F.lit(p.tasks * BUCKETS))
    return rows.withColumn("__lode_at", at).join(buckets, F.col("__lode_at") == F.col("__lode_bucket")).drop("__lode_at", "__lode_bucket")


def fragments(df: DataFrame, p: Plan, keep_together: Sequence[str] = (), move: bool = True) -> DataFrame:
    """``df`` with ``__lode_task``, each row moved there. A split key's rows are dealt evenly, or by a hash of
    ``keep_together`` where equal values have to meet (distinct counts).

    Dealing evenly goes by the place of a row in its input partition, so ``df`` should be a table as it is read (or
    :func:`lodestream.scratch.written`): a task that is run again then deals its rows as before."""
    salt = F.xxhash64(*keep_together) if keep_together else F.monotonically_increasing_id()
    rows = _placed(df.withColumn("__lode_salt", salt), p)
    shard = F.pmod(F.col("__lode_salt"), F.size("__lode_tasks").cast("long")).cast("int")
    rows = rows.withColumn(TASK, F.coalesce(F.col("__lode_tasks")[shard], F.col("__lode_owner")))
    rows = rows.drop("__lode_salt", "__lode_tasks", "__lode_owner")
    return rows.repartitionById(p.tasks, F.col(TASK)) if move else rows


def replicas(match: DataFrame, p: Plan) -> DataFrame:
    """``match`` once for each task that holds rows of its key: once for most keys, per shard for split ones."""
    rows = _placed(match, p)
    where = F.coalesce(F.array_distinct("__lode_tasks"), F.array("__lode_owner"))
    return rows.withColumn(TASK, F.explode(where)).drop("__lode_tasks", "__lode_owner").repartitionById(p.tasks, F.col(TASK))


def balanced_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", extra: Sequence[str] = (), tasks: int | None = None, split: float = SPLIT) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (and ``extra`` equal columns), ``how`` inner or left.

    Rows of a heavy key of ``left`` are spread over its shards and only those get ``right``'s rows of the key.
    Null keys never match: inner drops them, left keeps them unmatched. ``right``'s columns that ``left`` also has
    are dropped, the join columns first of all. Empty inputs give an empty (or unmatched) result; repeated rows
    multiply as in any join.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how has to be inner or left, not {how!r}")
    p = plan(left, key, tasks, split)
    a, b = fragments(left, p), replicas(right.where(F.col(key).isNotNull()), p)
    on = [key, *extra]
    b = b.select(TASK, *[F.col(c).alias(f"__lode_r_{c}") for c in on], *[c for c in right.columns if c not in left.columns])
    cond = a[TASK] == b[TASK]
    for c in on:
        cond &= a[c] == b[f"__lode_r_{c}"]
    return a.join(b, cond, how).drop(*[f"__lode_r_{c}" for c in on], TASK)


def balanced_results(df: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], keep_together: Sequence[str] = (), tasks: int | None = None, split: float = SPLIT) -> DataFrame:
    """One row per key with ``final`` expressions over the ``partial`` aggregates of its shards.

    ``partial`` runs once per (key, task) where the rows lie, without another shuffle; ``final`` combines the few
    partial rows of a key. Null keys form one result row, an empty table gives none, repeated rows count as stored,
    and columns beside the ones used are pruned.
    """
    p = plan(df, key, tasks, split)
    rows = fragments(df, p, keep_together)
    parts = rows.groupBy(TASK, key).agg(*[c.alias(n) for n, c in partial.items()])
    return parts.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def heavy_keys(df: DataFrame, key: str, share: float, tasks: int | None = None) -> DataFrame:
    """``key, rows, share`` of the non-null keys with at least ``share`` of all rows of ``df``, nulls included.

    Counts come from :func:`balanced_results`, so the tasks are even however large one key is. An exact check
    against the total follows.
    """
    counts = balanced_results(df.select(key), key, {"__lode_n": F.count("*")}, {"rows": F.sum("__lode_n")}, tasks=tasks)
    counts = written(counts, "counts")
    total = counts.agg(F.sum("rows").alias("__lode_total"))
    out = counts.crossJoin(F.broadcast(total))  # one row
    return out.where(F.col(key).isNotNull() & (F.col("rows") / F.col("__lode_total") >= share)).select(key, "rows", (F.col("rows") / F.col("__lode_total")).alias("share"))


__all__ = ["Plan", "balanced_join", "balanced_results", "fragments", "heavy_keys", "pack", "plan", "replicas", "same"]
