"""Distributed order: range sort, ranks and running totals without one task holding a group.

A window over a whole group puts the group into one task. Here the rows are sorted by range over all tasks,
every range partition reports one count per group, and the few counts are summed up into offsets; a row's
position in its group is the offset of its partition plus its position inside it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.scratch import written
from lodestream.session import tasks

PART, POS = "__lode_part", "__lode_pos"
_LOCAL = (1 << 33) - 1


#: The most that a checked side may hold to be broadcast.
MOST_BYTES = 64 << 20


def small(df: DataFrame, most: int = 100_000, weight: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is seen to have at most ``most`` rows and MOST_BYTES; else as it is, for a shuffled join.

    With ``weight``, its sum is held against ``most`` (rows that carry lists). Texts and lists count with their lengths, other columns with
    eight bytes. The count runs first, so ``df`` should be cheap or written.
    """
    width = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            width += 8 * F.greatest(F.size(f.name), F.lit(0))
    rows = df.limit(most + 1) if weight is None else df
    seen = rows.agg((F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= most and seen["b"] <= MOST_BYTES else df


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def range_sorted(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted over all tasks, with ``__lode_part`` (range partition) and ``__lode_pos`` (row in it, from 0), written once.

    ``order`` has to end in something nearly unique, else equal rows share one partition. The bounds are
    sampled, so the result is written before anything reads it twice.
    """
    n = parts or tasks(df.sparkSession)
    row = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(POS, row)
    return written(ranged.withColumn(PART, F.shiftright(POS, 33).cast("int")).withColumn(POS, F.col(POS).bitwiseAND(F.lit(_LOCAL))), "sorted")


def ranked(df: DataFrame, order: Sequence[Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with the global position in ``order`` (from 1). One shuffle; the offsets are one row a partition."""
    rows = range_sorted(df, order, parts)
    sizes = rows.groupBy(PART).agg(F.count("*").alias("__lode_n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select(PART, F.coalesce(F.sum("__lode_n").over(before), F.lit(0)).alias("__lode_before"))
    out = rows.join(F.broadcast(offsets), PART)  # at most as many rows as range partitions
    return out.withColumn(name, F.col("__lode_before") + F.col(POS) + 1).drop(PART, POS, "__lode_before")


def cumulative_frequencies(df: DataFrame, groups: Sequence[str], value: str, descending: bool = False, parts: int | None = None, weight: str | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """Distinct values per group with running counts: ``groups, value, n, before, upto, total``.

    With ``weight``, a row counts that often instead of once. Each number in ``beside`` is summed up in the same way, into ``<c>, <c>_upto, <c>_total``.

    ``n`` rows have the value, ``before`` rows of the group come earlier in the order, ``upto`` = before + n.
    Equal values are counted before the shuffle, so ties cost nothing; the distinct values are range-sorted by
    (group, value), and the windows run inside one (group, range partition) or over one row per range partition.
    Rows with a null value are left out, as in aggregates.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"), *[F.sum(c).alias(c) for c in beside])
    by = F.col(value).desc() if descending else F.col(value).asc()
    rows = range_sorted(counted, [*[F.col(g).asc() for g in groups], by], parts).drop(POS)
    sums = ["n", *beside]
    sizes = rows.groupBy(*groups, PART).agg(*[F.sum(c).alias(f"__lode_size_{c}") for c in sums])
    whole = Window.partitionBy(*groups)
    ahead = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a range partition
    before = [F.coalesce(F.sum(f"__lode_size_{c}").over(ahead), F.lit(0)).alias(f"__lode_before_{c}") for c in sums]
    offsets = sizes.select(*groups, PART, *before, *[F.sum(f"__lode_size_{c}").over(whole).alias(f"__lode_total_{c}") for c in sums])
    inside = Window.partitionBy(*groups, PART).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"__lode_run_{c}": F.sum(c).over(inside) for c in sums})
    out = run.join(offsets, same(run, offsets, [*groups, PART]))
    upto = {c: F.col(f"__lode_before_{c}") + F.col(f"__lode_run_{c}") for c in sums}
    more = [x for c in beside for x in (F.col(c), upto[c].alias(f"{c}_upto"), F.col(f"__lode_total_{c}").alias(f"{c}_total"))]
    return out.select(*[run[g] for g in groups], run[value], "n", (upto["n"] - F.col("n")).alias("before"), upto["n"].alias("upto"), F.col("__lode_total_n").alias("total"), *more)


def interpolated(df: DataFrame, groups: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """``groups, readings`` and per name of ``points`` the exact quantile, linear between the two neighbouring order statistics.

    Null values are left out. The sort is distributed; the aggregate picks two values per point in each group.
    """
    rows = cumulative_frequencies(df, groups, value)
    last = F.col("total") - 1
    stats = []
    for k, q in enumerate(points.values()):
        at = F.floor(last * F.lit(float(q)))
        for side, rank in (("lo", at), ("hi", F.least(at + 1, last))):
            stats.append(F.max(F.when((F.col("before") <= rank) & (rank < F.col("upto")), F.col(value))).alias(f"_{side}{k}"))
    found = rows.groupBy(*groups).agg(F.max("total").alias("readings"), *stats)
    out = []
    for k, (name, q) in enumerate(points.items()):
        at = (F.col("readings") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (at - F.floor(at))).alias(name))
    return found.select(*groups, "readings", *out)
