"""A score cutoff per source that keeps a target share of the source's records.

Distinct scores are counted per source before the shuffle; descending running counts come from the range sort of
:func:`lodestream.operators.ordered.cumulative_frequencies`, so a source with a third of all rows is spread over
range partitions; the cutoff is an aggregate over the few crossing candidates each task finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.functions.clean import finite
from lodestream.operators.ordered import cumulative_frequencies, small


def cutoffs(df: DataFrame, targets: DataFrame, source: str, score: str, fraction: str, closest: bool = False) -> DataFrame:
    """``source, fraction, cutoff, kept, total, share``, a row per source of ``df`` or ``targets``.

    The cutoff is the highest score value whose records at or above it are at least ``fraction`` of the source's; with
    ``closest``, the value whose share is nearest to ``fraction`` (the higher one of two equally near). Records with a null,
    NaN or infinite score do not count, nor do records without a source. Ties share a score and are kept or left
    together. A source without a target, or without records, has a null cutoff and keeps none. ``targets`` has one row a source.
    """
    rows = df.where(F.col(source).isNotNull()).select(source, finite(F.col(score)).alias("__lode_score"))
    counts = cumulative_frequencies(rows, [source], "__lode_score", descending=True)
    goal = small(targets.where(F.col(source).isNotNull()).select(F.col(source).alias("__lode_s"), F.col(fraction).cast("double").alias("__lode_f")))
    both = counts.join(goal, counts[source] == F.col("__lode_s"), "left")
    share = F.col("upto") / F.col("total")
    if closest:
        best = F.min_by(F.struct("__lode_score", "upto"), F.struct(F.abs(share - F.col("__lode_f")), -F.col("__lode_score")))
        best = F.when(F.first("__lode_f", ignorenulls=True).isNotNull(), best)
        cut, kept = best["__lode_score"], best["upto"]
    else:
        enough = share >= F.col("__lode_f")
        cut, kept = F.max(F.when(enough, F.col("__lode_score"))), F.min(F.when(enough, F.col("upto")))
    found = both.groupBy(source).agg(cut.alias("cutoff"), kept.alias("kept"), F.max("total").alias("total"))
    goal = targets.where(F.col(source).isNotNull()).select(source, F.col(fraction).cast("double").alias(fraction))
    out = found.join(goal, source, "full")
    kept = F.coalesce("kept", F.lit(0))
    total = F.coalesce("total", F.lit(0))
    return out.select(source, fraction, "cutoff", kept.alias("kept"), total.alias("total"), F.when(total > 0, kept / total).alias("share"))


def kept(df: DataFrame, cuts: DataFrame, source: str, score: str) -> DataFrame:
    """The rows of ``df`` at or above the cutoff of their source, columns as they are."""
    cut = small(cuts.where(F.col("cutoff").isNotNull()).select(F.col(source).alias("__lode_s"), F.col("cutoff").alias("__lode_c")))
    return df.join(cut, (df[source] == F.col("__lode_s")) & (finite(df[score]) >= F.col("__lode_c")), "left_semi")


