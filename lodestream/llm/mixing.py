"""Sources mixed to target weights by Poisson replication.

A document's repeats are a Poisson number, inverted from a hash of its id and the seed, so they need no state, no
order and no second pass and are the same on every run. The mean is the source's target rate; repeats end at the source's cap, and
the mean of the capped distribution is what is matched, so a cap alone doesn't lower a share.

A source that stays short of its share of all tokens even at its cap is used at its cap. The size of the mixture is then the one at which these
sources together have their shares, and every other source is drawn to its own share of that size: it reaches its target up to chance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.ordered import ranked
from lodestream.scratch import written


def source_name(column: str) -> Column:
    """Lower case without blanks at the ends; null where nothing is left."""
    name = F.lower(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name != "", name)


def capped_poisson(rate: float, cap: int) -> list[float]:
    """The chances of at most 0, 1, ... cap - 1 repeats, of a Poisson number cut off at ``cap`` whose mean is ``rate``.

    A rate of ``cap`` or more gives zeros: always ``cap`` repeats.
    """
    if cap < 1 or rate <= 0:
        return [1.0] * max(cap, 1)
    if rate >= cap:
        return [0.0] * cap

    def cdf(mean: float) -> list[float]:
        total, out = 0.0, []
        for k in range(cap):
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
            out.append(min(1.0, total))
        return out

    low, high = 0.0, 10.0 * cap + 50
    for _ in range(200):
        mid = (low + high) / 2
        if cap - sum(cdf(mid)) < rate:  # the mean of min(N, cap) is the sum of P(N > k) for k < cap
            low = mid
        else:
            high = mid
    return cdf(high)


def rates(sizes: DataFrame, weights: DataFrame, shrink: bool = True) -> DataFrame:
    """A row per source of ``weights``: ``source, target_weight, max_repeats, own, squares, total, target_share, rate, reachable``.

    ``sizes`` has ``source, size`` of all documents; those without a source don't count. A share of ``total``, the size of all sources, is out of
    reach if even ``max_repeats`` repeats of all fall short. ``rate`` is the mean number of repeats: ``max_repeats`` where the share is out of
    reach, else what gives ``target_share`` of the mixture (the weight among the sources that have documents). With ``shrink`` the mixture
    is as large as the capped sources allow, without it as large as ``total`` asks for, and the reachable sources exceed their share.
    """
    own = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("size").alias("own"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    rows = weights.select(source_name("source").alias("source"), F.col("target_weight").cast("double").alias("target_weight"), F.col("max_repeats").cast("int").alias("max_repeats"))
    rows = rows.join(own, "source", "left").crossJoin(F.broadcast(total)).withColumn("own", F.coalesce("own", F.lit(0)))  # one row
    most = F.col("own") * F.col("max_repeats")
    rows = rows.withColumn("reachable", most >= F.col("target_weight") * F.col("total"))
    there, capped = F.col("own") > 0, (F.col("own") > 0) & ~F.col("reachable")
    sums = rows.agg(F.sum(F.when(there, F.col("target_weight"))).alias("_w"), F.sum(F.when(capped, most)).alias("_size"), F.sum(F.when(capped, F.col("target_weight"))).alias("_cw"))
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    per = F.when((F.col("_cw") > 0) & F.lit(shrink), F.col("_size") / F.col("_cw")).otherwise(F.col("total") / F.col("_w"))  # size of a whole weight
    rate = F.when(capped, F.col("max_repeats").cast("double")).when(there, F.least(F.col("target_weight") * per / F.col("own"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.select("source", "target_weight", "max_repeats", "own", F.coalesce("squares", F.lit(0.0)).alias("squares"), "total", F.when(there, F.col("target_weight") / F.col("_w")).alias("target_share"), rate.alias("rate"), "reachable")


def spread(steps: list[float]) -> float:
    """The variance of the repeats that :func:`capped_poisson` describes."""
    mean, square = sum(1 - c for c in steps), sum((2 * k + 1) * (1 - c) for k, c in enumerate(steps))
    return max(0.0, square - mean * mean)


def mixed(documents: DataFrame, weights: DataFrame, key: str, source: str, size: str, seed: int = 0, shrink: bool = True) -> tuple[DataFrame, DataFrame]:
    """The mixture (``key, source, size, repeat, position``) and its report.

    ``position`` is a global random order by hash. Report: the columns of :func:`rates` and ``documents`` (rows given), ``size``,
    ``actual_share`` and ``tolerance``: four standard errors that chance leaves in the share. Documents without a source or of a source without a
    weight aren't drawn. Equal keys draw equally; null keys draw as one. ``weights`` has a row per source (it is read by the driver: a
    table of parameters).
    """
    docs = written(documents.select(key, source_name(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size")), "sizes")
    plan = [r.asDict() for r in rates(docs, weights, shrink).collect()]
    spark = documents.sparkSession
    steps = [(r["source"], capped_poisson(r["rate"], r["max_repeats"])) for r in plan if r["source"] is not None]
    variance = dict((s, spread(c)) for s, c in steps)
    drawn = spark.createDataFrame(steps, "source string, _cdf array<double>")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    rows = docs.join(F.broadcast(drawn), "source")  # one row per row of the parameter table `weights`
    rows = rows.withColumn("_u", uniform).withColumn("_n", F.size(F.filter("_cdf", lambda c: F.col("_u") >= c)))
    rows = rows.where(F.col("_n") > 0).select(key, "source", "size", F.explode(F.sequence(F.lit(1), "_n")).alias("repeat"))
    order = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("repeat"))
    mixture = ranked(rows, [order, F.col(key), F.col("repeat")])
    actual = mixture.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
    whole = actual.agg(F.sum("size").alias("_whole"))
    errors = {r["source"]: (variance.get(r["source"], 0.0) * r["squares"]) ** 0.5 for r in plan}
    all_ = sum(e * e for e in errors.values()) ** 0.5
    head = [(*[v for k, v in r.items() if k != "squares"], errors[r["source"]]) for r in plan]
    head = spark.createDataFrame(head, "source string, target_weight double, max_repeats int, own long, total long, target_share double, rate double, reachable boolean, _e double")
    report = head.join(actual, "source", "left").crossJoin(F.broadcast(whole))  # one row
    got = F.coalesce("size", F.lit(0))
    report = report.withColumns({"documents": F.coalesce("documents", F.lit(0)), "size": got, "actual_share": got / F.col("_whole")})
    return mixture, report.withColumn("tolerance", 4 * (F.col("_e") + F.col("actual_share") * F.lit(all_)) / F.col("_whole")).drop("_whole", "_e")
