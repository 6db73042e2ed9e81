"""Percentiles per group from one distributed sort, and summaries that can be put together later.

Exact: the distinct values are range-sorted over all tasks by (group, value), counts per range partition give each
group's offsets, the target positions are located in them and the two neighbouring order statistics are
interpolated. Mergeable: of the same sorted values every ``step``-th rank is kept with the rows it stands for;
summaries of days or files are unioned, and their weights are sorted and summed in the same way. A rank read from
merged summaries is off by less than ``error`` times the rows that went into them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.clean import finite
from lodestream.operators.ordered import cumulative_frequencies, interpolated


def melted(df: DataFrame, groups: Sequence[str], values: Sequence[str], name: str = "field") -> DataFrame:
    """``name, groups, value``: the finite values of several columns below one another, so one sort serves them all."""
    pairs = F.array(*[F.struct(F.lit(v).alias(name), finite(F.col(v)).alias("value")) for v in values])
    return df.select(*groups, F.explode(pairs).alias("_p")).select(f"_p.{name}", *groups, "_p.value").where(F.col("value").isNotNull())


def quantiles(df: DataFrame, groups: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """``groups, readings`` and a column per name of ``points``: the exact linearly interpolated quantiles.

    Null, NaN and infinite values are left out; a group without values has no row; null group keys are groups; ties and
    repeated rows count as often as they occur.
    """
    return interpolated(df.select(*groups, finite(F.col(value)).alias("_v")), groups, "_v", points)


def summary(df: DataFrame, groups: Sequence[str], value: str, error: float) -> DataFrame:
    """``groups, value, weight``: at most 2 + 2 / error rows a group, whose weights add up to the group's readings."""
    rows = cumulative_frequencies(df.select(*groups, finite(F.col(value)).alias("_v")), groups, "_v")
    step = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(float(error))))
    # The value stays whose ranks reach a multiple of step; it stands for all ranks since the multiple before.
    passed, reached = F.floor(F.col("before") / step), F.floor(F.col("upto") / step)
    end = F.col("upto") == F.col("total")
    kept = rows.where((reached > passed) | end)
    weight = F.when(end, F.col("total")).otherwise(reached * step) - passed * step
    return kept.select(*groups, F.col("_v").alias("value"), weight.cast("long").alias("weight"))


def merged_quantiles(parts: DataFrame, groups: Sequence[str], points: Mapping[str, float]) -> DataFrame:
    """``groups, readings`` and quantiles (a value that occurs, nearest rank) over unioned :func:`summary` rows.

    The true rank of each result differs from the asked one by less than the error of the summaries times ``readings``.
    """
    rows = cumulative_frequencies(parts, groups, "value", weight="weight")
    stats = [F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(float(q))), F.col("value"))).alias(n) for n, q in points.items()]
    return rows.groupBy(*groups).agg(F.max("total").alias("readings"), *stats)
