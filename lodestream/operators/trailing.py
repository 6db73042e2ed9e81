"""Totals over trailing calendar periods from segment trees, one tree per entity and time shard.

A tree is two arrays per measure (sums and counts) in heap order: node 1 spans the shard, node ``n`` has the
children ``2n`` and ``2n + 1``, leaf ``days + i`` is day ``i`` of the shard. A trailing period touches at most the
shard itself and the one before, and is answered from O(log days) nodes of each. A late correction changes the
nodes on one path, leaf to root, of one tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.ordered import same
from lodestream.scratch import written

#: Days of a shard: a power of two, and the longest period that can be asked for.
DAYS = 32
_EPOCH = "1970-01-01"


def cover(first: int, last: int, days: int = DAYS) -> list[int]:
    """The fewest nodes that span the leaves ``first`` to ``last`` (none if last < first)."""
    lo, hi, left, right = first + days, last + days + 1, [], []
    while lo < hi:
        if lo & 1:
            left.append(lo)
            lo += 1
        if hi & 1:
            hi -= 1
            right.append(hi)
        lo, hi = lo >> 1, hi >> 1
    return left + right[::-1]


def _number(of: str) -> Column:
    return F.datediff(F.col(of), F.lit(_EPOCH).cast("date"))


def leaves(df: DataFrame, entity: str, day: str, measures: Sequence[str], key: str | None = None) -> DataFrame:
    """Per entity and active day ``s_<measure>``, ``c_<measure>``: sum and number of readings that count.

    Null, NaN, infinite and negative values are no readings (they add 0); an entity's day exists as soon as it has a
    row. With ``key``, repeats of a non-null key count once. Rows without a day cannot be placed and are left out;
    a null entity is an entity. One shuffle, by (entity, day), so a busy entity is spread over its days.
    """
    rows = df.where(F.col(day).isNotNull()).select(*([key] if key else []), entity, day, *measures).repartition(entity, day)
    if key:
        alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
        rows = rows.withColumn("_alone", alone).groupBy(entity, day, key, "_alone").agg(*[F.first(m).alias(m) for m in measures])
    total: list[Column] = []
    for m in measures:
        x = F.col(m).cast("double")
        good = F.when((x >= 0) & ~F.isnan(x) & (x != float("inf")), x)
        total += [F.coalesce(F.sum(good), F.lit(0.0)).alias(f"s_{m}"), F.count(good).alias(f"c_{m}")]
    return rows.groupBy(entity, day).agg(*total)


def trees(daily: DataFrame, entity: str, day: str, measures: Sequence[str], days: int = DAYS) -> DataFrame:
    """``entity, shard, first, last`` (day numbers with rows) and the node arrays of each measure."""
    cols = [f"{p}_{m}" for m in measures for p in "sc"]
    number = daily.withColumn("_d", _number(day)).withColumn("shard", F.floor(F.col("_d") / days).cast("int"))
    rows = number.groupBy(entity, "shard").agg(  # at most `days` entries in a list
        F.min("_d").alias("first"), F.max("_d").alias("last"),
        F.map_from_entries(F.collect_list(F.struct((F.col("_d") - F.col("shard") * days).alias("k"), F.struct(*cols).alias("v")))).alias("_leaf"),
    )
    every = F.sequence(F.lit(0), F.lit(days - 1))
    zero = {c: F.lit(0.0) if c.startswith("s_") else F.lit(0).cast("long") for c in cols}

    def placed(c: str) -> Column:
        return F.transform(every, lambda i: F.coalesce(F.col("_leaf")[i][c], zero[c])).alias(f"{c}_{days}")

    def parents(c: str, w: int) -> Column:
        below = F.col(f"{c}_{2 * w}")
        return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: below[i * 2] + below[i * 2 + 1]).alias(f"{c}_{w}")

    rows = rows.select(entity, "shard", "first", "last", *[placed(c) for c in cols])
    width = days
    while width > 1:
        width //= 2
        rows = rows.select("*", *[parents(c, width) for c in cols])
    levels = [1 << k for k in range(days.bit_length())]
    return rows.select(entity, "shard", "first", "last", *[F.concat(F.array(zero[c]), *[F.col(f"{c}_{w}") for w in levels]).alias(c) for c in cols])


def corrected(forest: DataFrame, changes: DataFrame, entity: str, day: str, measures: Sequence[str], days: int = DAYS) -> DataFrame:
    """``forest`` after late corrections: ``changes`` has ``entity, day`` and the differences ``s_<m>``, ``c_<m>``.

    Each change adds to the log2(days) + 1 nodes from its leaf to the root and to no other. Changes of the same day add
    up; a shard that has no tree yet gets one. Only the trees of time shards with a change are read into the join; all others pass as they are
    stored (a forest kept by shard isn't rewritten). The driver sees the numbers of those shards, one per ``days`` days of changes.
    """
    cols = [f"{p}_{m}" for m in measures for p in "sc"]
    height = days.bit_length() - 1
    moved = changes.where(F.col(day).isNotNull()).withColumn("_d", _number(day)).withColumn("shard", F.floor(F.col("_d") / days).cast("int"))
    leaf = F.col("_d") - F.col("shard") * days + days
    path = F.explode(F.array(*[F.shiftright(leaf, k) for k in range(height + 1)])).alias("_node")
    nodes = moved.select(entity, "shard", "_d", path, *cols).groupBy(entity, "shard", "_node").agg(F.min("_d").alias("_min"), F.max("_d").alias("_max"), *[F.sum(c).alias(c) for c in cols])
    delta = nodes.groupBy(entity, "shard").agg(  # at most 2 * days nodes in a map
        F.min("_min").alias("_min"), F.max("_max").alias("_max"),
        F.map_from_entries(F.collect_list(F.struct(F.col("_node").alias("k"), F.struct(*cols).alias("v")))).alias("_by_node"),
    )
    delta = written(delta, "delta")
    touched = [r["shard"] for r in delta.select("shard").distinct().collect()]
    rest, forest = forest.where(~F.col("shard").isin(touched)), forest.where(F.col("shard").isin(touched))
    both = forest.join(delta, same(forest, delta, [entity, "shard"]), "full")
    every = F.sequence(F.lit(0), F.lit(2 * days - 1))

    def changed(c: str) -> Column:
        zero = F.lit(0.0) if c.startswith("s_") else F.lit(0).cast("long")
        new = F.transform(every, lambda i: F.coalesce(forest[c][i], zero) + F.coalesce(F.col("_by_node")[i][c], zero))
        return F.when(F.col("_by_node").isNull(), forest[c]).otherwise(new).alias(c)

    own = [F.when(forest["shard"].isNotNull(), forest[c]).otherwise(delta[c]).alias(c) for c in (entity, "shard")]
    moved = both.select(*own, F.least("first", "_min").alias("first"), F.greatest("last", "_max").alias("last"), *[changed(c) for c in cols])
    return rest.select(moved.columns).unionByName(moved)


def trailing(forest: DataFrame, entity: str, measures: Sequence[str], periods: Sequence[int], days: int = DAYS) -> DataFrame:
    """A row for each entity and day from its first to its last day with rows, active or not.

    Columns ``<measure>_total_<p>``, ``<measure>_readings_<p>``, ``<measure>_mean_<p>`` (per reading, null without one) and
    ``<measure>_day_mean_<p>`` (total / p, quiet days included) for each period of p days, the day itself included.
    An empty forest gives an empty result.
    """
    if max(periods) > days or min(periods) < 1:
        raise ValueError(f"periods have to be 1 to {days} days")
    cols = [f"{p}_{m}" for m in measures for p in "sc"]
    line, whole = Window.partitionBy(entity).orderBy("shard"), Window.partitionBy(entity)  # a row a shard, not a day
    linked = forest.select(
        entity, "shard", *cols, F.min("first").over(whole).alias("_first"), F.max("last").over(whole).alias("_last"),
        F.lead("shard").over(line).alias("_next"), (F.lag("shard").over(line) == F.col("shard") - 1).alias("_linked"),
        *[F.lag(c).over(line).alias(f"p_{c}") for c in cols],
    )
    # A gap of whole shards without rows still has days: its first shard sees the tree before, the others see none.
    until = F.coalesce(F.col("_next") - 1, F.col("shard"))
    steps = linked.withColumn("_s", F.explode(F.sequence("shard", until)))
    here, after = F.col("_s") == F.col("shard"), F.col("_s") == F.col("shard") + 1
    steps = steps.select(
        entity, "_s", "_first", "_last",
        *[F.when(here, F.col(c)).alias(f"x_{c}") for c in cols],
        *[F.when(here & F.col("_linked"), F.col(f"p_{c}")).when(after, F.col(c)).alias(f"y_{c}") for c in cols],
    )
    table = lambda lists: F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<int>") for x in lists])
    now = {p: table([cover(max(0, e - p + 1), e, days) for e in range(days)]) for p in periods}
    ago = {p: table([cover(days + e - p + 1, days - 1, days) for e in range(days)]) for p in periods}

    def answer(c: str, p: int, e: Column) -> Column:
        zero = F.lit(0.0) if c.startswith("s_") else F.lit(0).cast("long")
        part = lambda nodes, side: F.aggregate(nodes[p][e], zero, lambda a, n: a + F.coalesce(F.col(f"{side}_{c}")[n], zero))
        return part(now, "x") + part(ago, "y")

    lo = F.greatest(F.lit(0), F.col("_first") - F.col("_s") * days)
    hi = F.least(F.lit(days - 1), F.col("_last") - F.col("_s") * days)
    answers = F.transform(F.sequence(lo, hi), lambda e: F.struct(e.alias("e"), *[answer(c, p, e).alias(f"{c}_{p}") for c in cols for p in periods]))
    rows = steps.where(hi >= lo).select(entity, "_s", F.explode(answers).alias("a"))
    out = [F.date_add(F.lit(_EPOCH).cast("date"), F.col("_s") * days + F.col("a.e")).alias("day")]
    for m in measures:
        for p in periods:
            s, n = F.col(f"a.s_{m}_{p}"), F.col(f"a.c_{m}_{p}")
            out += [s.alias(f"{m}_total_{p}"), n.alias(f"{m}_readings_{p}"), F.when(n > 0, s / n).alias(f"{m}_mean_{p}"), (s / p).alias(f"{m}_day_mean_{p}")]
    return rows.select(entity, *out)


def shard_days(periods: Sequence[int]) -> int:
    """Days of a time shard: a power of two that the longest period fits into, 32 at least."""
    return max(DAYS, 1 << (max(periods) - 1).bit_length())


def trailing_totals(df: DataFrame, entity: str, day: str, measures: Sequence[str], periods: Sequence[int], key: str | None = None) -> DataFrame:
    """:func:`leaves`, :func:`trees` and :func:`trailing` in one call, with shards as long as the periods need."""
    days = shard_days(periods)
    return trailing(trees(leaves(df, entity, day, measures, key), entity, day, measures, days), entity, measures, periods, days)
