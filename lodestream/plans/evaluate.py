"""Queries of model evaluation, encodings and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.clean import once
from lodestream.operators import evaluation as E
from lodestream.operators import sampling
from lodestream.operators.hourly import nudged
from lodestream.plans.hours import r6
from lodestream.plans.registry import Registry, table
from lodestream.scratch import written

REGISTRY = Registry()
add = REGISTRY.add

ROWS = "rows_ AS (SELECT DISTINCT ON (score_id) score_id, app_id, device_id, hour, anomaly AS y, shortSessionAnomaly, ZerobytesUsagenAnomaly, Severity_label, Severity_final AS s FROM severity_scores)"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["score_id", "app_id", "device_id", "hour", F.col("anomaly").alias("y"), "shortSessionAnomaly", "ZerobytesUsagenAnomaly", "Severity_label", F.col("Severity_final").alias("s")]
    return written(once(table(spark, folder, "severity_scores").select(*cols), "score_id"), "rows")


def _h(n: str, total: str) -> str:
    return f"-sum({n} / {total} * log2({n} / {total}))"


@add("entropy", f"WITH {ROWS}, c AS (SELECT y, count(*) AS n FROM rows_ WHERE y IS NOT NULL GROUP BY y) SELECT CAST(sum(n) AS BIGINT) AS n, {r6('-sum(n / t * log2(n / t))')} AS entropy FROM c, (SELECT sum(n) AS t FROM c)")
def entropy(spark: SparkSession, folder: str) -> DataFrame:
    return E.entropy(_rows(spark, folder), "y").withColumn("entropy", nudged(F.col("entropy")))


FEATURES = ["app_id", "hour", "shortSessionAnomaly", "ZerobytesUsagenAnomaly", "Severity_label"]
_GAINS = (
    f"WITH {ROWS}, l AS (" + " UNION ALL ".join(f"SELECT y, '{f}' AS feature, CAST({f} AS VARCHAR) AS v FROM rows_ WHERE y IS NOT NULL" for f in FEATURES) + """),
    c AS (SELECT feature, v, y, count(*) AS n FROM l GROUP BY ALL), sides AS (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS side, sum(n) OVER (PARTITION BY feature) AS total FROM c),
    ch AS (SELECT feature, sum(-n / total * log2(n / side)) AS children FROM sides GROUP BY feature),
    p AS (SELECT feature, sum(-n / total * log2(n / total)) AS parent FROM (SELECT feature, y, sum(n) AS n, any_value(total) AS total FROM sides GROUP BY feature, y) GROUP BY feature)
    """
)


@add("information_gain", _GAINS + f"SELECT feature, {r6('parent')} AS parent, {r6('children')} AS children, {r6('parent - children')} AS gain FROM ch JOIN p USING (feature)")
def information_gain(spark: SparkSession, folder: str) -> DataFrame:
    return E.information_gain(_rows(spark, folder), "y", FEATURES).select("feature", *[nudged(F.col(c)).alias(c) for c in ("parent", "children", "gain")])


@add("best_split", _GAINS + f"SELECT feature, {r6('parent - children')} AS gain FROM ch JOIN p USING (feature) ORDER BY parent - children DESC, feature LIMIT 1")
def best_split(spark: SparkSession, folder: str) -> DataFrame:
    gains = written(E.information_gain(_rows(spark, folder), "y", FEATURES), "gains")
    return E.best_split(gains).withColumn("gain", nudged(F.col("gain")))


_CONF = "SELECT count(CASE WHEN y = 1 AND g = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND g = 1 THEN 1 END) AS fp, count(CASE WHEN y = 1 AND g = 0 THEN 1 END) AS fn, count(CASE WHEN y = 0 AND g = 0 THEN 1 END) AS tn FROM (SELECT y, CASE WHEN s >= 0.5 THEN 1 ELSE 0 END AS g FROM rows_ WHERE s IS NOT NULL AND NOT isnan(s))"


@add("confusion_matrix", f"WITH {ROWS}, c AS ({_CONF}) SELECT *, {r6('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy, {r6('tp / (tp + fp)')} AS precision, {r6('tp / (tp + fn)')} AS recall, {r6('2 * tp / (2 * tp + fp + fn)')} AS f1 FROM c")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).where(F.col("s").isNotNull() & ~F.isnan("s"))
    out = E.confusion(rows, F.col("y"), F.when(F.col("s") >= 0.5, 1).otherwise(0))
    return out.withColumns({c: nudged(F.col(c)) for c in ("accuracy", "precision", "recall", "f1")})


_CURVE = f"""{ROWS}, c AS (SELECT s, count(*) AS n, sum(y) AS p FROM rows_ WHERE y IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) GROUP BY s),
    k AS (SELECT s AS score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n - p) OVER w AS BIGINT) AS fp, CAST(sum(p) OVER () AS BIGINT) AS positives, CAST(sum(n - p) OVER () AS BIGINT) AS negatives FROM c WINDOW w AS (ORDER BY s DESC))"""


@add("roc_points", f"WITH {_CURVE} SELECT * FROM k")
def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return E.curve(_rows(spark, folder), "y", "s").drop("tp_step", "fp_step")


@add("pr_curve", f"WITH {_CURVE} SELECT score, {r6('tp / (tp + fp)')} AS precision, {r6('tp / positives')} AS recall FROM k")
def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.curve(_rows(spark, folder), "y", "s")
    return rows.select("score", nudged(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), nudged(F.col("tp") / F.col("positives")).alias("recall"))


@add(
    "roc_auc",
    f"""WITH {_CURVE}, l AS (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS ptp, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS pfp FROM k)
    SELECT {r6('sum((fp - pfp) * (tp + ptp) / 2.0) / max(positives * negatives)')} AS auc, {r6('sum((tp - ptp) * tp / (tp + fp)) / max(positives)')} AS average_precision FROM l""",
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    out = E.areas(E.curve(_rows(spark, folder), "y", "s"))
    return out.select(*[nudged(F.col(c)).alias(c) for c in out.columns])


_U = "CAST(('0x' || substr(md5('{seed}_' || {key}), 1, 8)) AS BIGINT) / 4294967296.0"
_PART = f"CASE WHEN {_U.format(seed=42, key='score_id')} < 0.6 THEN 'train' WHEN {_U.format(seed=42, key='score_id')} < 0.8 THEN 'validation' ELSE 'test' END"


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split(_rows(spark, folder), "score_id", {"train": 0.6, "validation": 0.2, "test": 0.2})


@add("train_split", f"WITH {ROWS} SELECT score_id, {_PART} AS part FROM rows_")
def train_split(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).select("score_id", "part")


@add(
    "target_encode",
    f"""WITH {ROWS}, t AS (SELECT *, {_PART} AS part FROM rows_), m AS (SELECT app_id, avg(y) AS a FROM t WHERE part = 'train' GROUP BY app_id)
    SELECT score_id, {r6("coalesce(a, (SELECT avg(y) FROM t WHERE part = 'train'))")} AS app_code FROM t LEFT JOIN m ON t.app_id IS NOT DISTINCT FROM m.app_id""",
)
def target_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted on the training part only, applied to all rows."""
    rows = _parts(spark, folder)
    out = E.target_encoding(rows.where("part = 'train'"), rows, "app_id", "y", "app_code")
    return out.select("score_id", nudged(F.col("app_code")).alias("app_code"))


@add("label_recode", f"WITH {ROWS} SELECT score_id, CASE Severity_label WHEN 'High' THEN 1 WHEN 'Low' THEN 0 END AS label FROM rows_")
def label_recode(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("score_id", F.when(F.col("Severity_label") == "High", 1).when(F.col("Severity_label") == "Low", 0).alias("label"))


@add("constant_columns", "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM alert_records" for c in ("DurationInMin", "AppId", "AnomalyCause", "DeviceId")) + """) SELECT "column", count(DISTINCT v) AS "distinct", count(*) AS rows, CASE WHEN count(DISTINCT v) <= 1 THEN 'constant' WHEN count(DISTINCT v) = count(*) THEN 'key' ELSE 'varying' END AS kind FROM l GROUP BY 1""")
def constant_columns(spark: SparkSession, folder: str) -> DataFrame:
    return E.constant_columns(table(spark, folder, "alert_records"), ["DurationInMin", "AppId", "AnomalyCause", "DeviceId"])


LEARNERS = 3
_GUESS = " UNION ALL ".join(f"SELECT score_id, CASE WHEN s >= {t} THEN 1 ELSE 0 END AS g FROM rows_ WHERE isfinite(s)" for t in (0.3, 0.5, 0.7))


@add("bagging_vote", f"WITH {ROWS}, g AS ({_GUESS}) SELECT score_id, count(*) AS learners, {r6('avg(g)')} AS mean, median(g) AS median, CASE WHEN sum(g) * 2 > count(*) THEN 1 ELSE 0 END AS majority FROM g GROUP BY score_id")
def bagging_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Three threshold learners, their mean, median and majority."""
    rows = _rows(spark, folder).where(F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != float("inf")))
    guess = F.explode(F.array(*[F.when(F.col("s") >= t, 1).otherwise(0) for t in (0.3, 0.5, 0.7)]))
    return E.votes(rows.select("score_id", guess.alias("g")), "score_id", "g").withColumn("mean", nudged(F.col("mean")))


_DRAW = "CAST(('0x' || substr(md5('7_' || score_id || '_' || learner), 1, 8)) AS BIGINT) / 4294967296.0"


@add("oob_split", f"WITH {ROWS}, b AS (SELECT score_id, unnest(range(3)) AS learner FROM rows_) SELECT score_id, CAST(learner AS INT) AS learner FROM b WHERE {_DRAW} < 0.36787944117144233")
def oob_split(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.out_of_bag(sampling.bags(_rows(spark, folder).select("score_id"), "score_id", LEARNERS))


def _draws_sql(most: int = 12) -> str:
    """Draws from a Poisson of mean 1: how many of its first cumulative chances the hash reaches."""
    u, p, total, steps = _U.format(seed=7, key="score_id || '_' || learner"), 0.36787944117144233, 0.0, []
    for k in range(most):
        total += p
        steps.append(f"CASE WHEN u >= CAST({total!r} AS DOUBLE) THEN 1 ELSE 0 END")
        p /= k + 1
    return f"drawn AS (SELECT learner, {' + '.join(steps)} AS draws FROM (SELECT learner, {u} AS u FROM rows_, (SELECT unnest(range({LEARNERS})) AS learner)))"


@add("bag_sizes", f"WITH {ROWS}, {_draws_sql()} SELECT CAST(learner AS INT) AS learner, count(*) AS rows, CAST(sum(draws) AS BIGINT) AS draws, count(CASE WHEN draws = 0 THEN 1 END) AS out_of_bag FROM drawn GROUP BY learner")
def bag_sizes(spark: SparkSession, folder: str) -> DataFrame:
    bags = sampling.bags(_rows(spark, folder).select("score_id"), "score_id", LEARNERS)
    return bags.groupBy("learner").agg(F.count("*").alias("rows"), F.sum("draws").alias("draws"), F.count(F.when(F.col("draws") == 0, 1)).alias("out_of_bag"))


@add("boosting_residuals", f"WITH {ROWS}, m AS (SELECT avg(y) AS f0 FROM rows_) SELECT score_id, {r6('f0')} AS f0, {r6('y - f0')} AS residual, {r6('2 * (y - f0)')} AS squared_gradient, {r6('y - 1 / (1 + exp(-f0))')} AS log_gradient FROM rows_, m")
def boosting_residuals(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.residuals(_rows(spark, folder), "y")
    return rows.select("score_id", *[nudged(F.col(c)).alias(c) for c in ("f0", "residual", "squared_gradient", "log_gradient")])


@add("standard_scaling", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) + 1e-9, 6) AS l_quantity_scaled FROM lineitem")
def standard_scaling(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.standardised(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_quantity"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", nudged(F.col("l_quantity_scaled")).alias("l_quantity_scaled"))
