"""Queries of severity, score reports, daily roll-ups and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.clean import day, number, once
from lodestream.operators import alerts as A
from lodestream.operators import severity as S
from lodestream.operators.hourly import nudged
from lodestream.plans.hours import r6
from lodestream.plans.registry import Registry, table
from lodestream.scratch import written
from lodestream.sources.sinks import batches

REGISTRY = Registry()
add = REGISTRY.add

NUM = "CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 0 ELSE {c} END"
ONCE = "once AS (SELECT DISTINCT ON (score_id) * FROM severity_scores)"
FINITE = "fin AS (SELECT score_id, app_id, device_id, date, hour, Severity_final AS s FROM (SELECT DISTINCT ON (score_id) * FROM severity_scores) WHERE isfinite(Severity_final))"


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "severity_scores"), "score_id")


def _finite(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "severity_scores").select("score_id", "app_id", "device_id", "date", "hour", F.col("Severity_final").alias("s"))
    return written(once(rows, "score_id").where(F.col("s").isNotNull() & ~F.isnan("s") & (F.abs("s") != float("inf"))), "finite")


def _squash_sql(k: str) -> str:
    return f"tanh(abs({NUM.format(c=S.COLUMNS[k])}) / 3.0)"


@add("numeric_coercion", "SELECT score_id, " + ", ".join(f"{NUM.format(c=c)} AS {c}" for c in S.COLUMNS.values()) + " FROM severity_scores")
def numeric_coercion(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "severity_scores").select("score_id", *[number(c).alias(c) for c in S.COLUMNS.values()])


@add("zscore_tanh_components", f"WITH {ONCE} SELECT score_id, " + ", ".join(f"{r6(_squash_sql(k))} AS {k}_score" for k in S.COLUMNS) + " FROM once")
def zscore_tanh_components(spark: SparkSession, folder: str) -> DataFrame:
    return S.components(_scores(spark, folder), S.Config()).select("score_id", *[nudged(F.col(f"{k}_score")).alias(f"{k}_score") for k in S.COLUMNS])


@add(
    "squash_methods",
    f"""WITH {ONCE} SELECT score_id, {r6("tanh(SL_z_score / 2.0)")} AS SL_score, {r6("1 / (1 + exp(-least(20, greatest(-20, abs(" + NUM.format(c="ZB_z_score") + ") / 3.0))))")} AS ZB_score,
    {r6("least(1, greatest(0, -1 * " + NUM.format(c="SC_z_score_session_cnt") + " / 3.0))")} AS SC_score, CAST(0 AS DOUBLE) AS NO_score FROM once""",
)
def squash_methods(spark: SparkSession, folder: str) -> DataFrame:
    """The other squashes, a scale, a polarity, a sign kept, and a column that isn't there."""
    c = S.Config(columns={"SL": "SL_z_score", "ZB": "ZB_z_score", "SC": "SC_z_score_session_cnt", "NO": "no_such_column"}, methods={"ZB": "logistic", "SC": "linear"}, scales={"SL": 2.0}, polarity={"SC": -1}, absolute={"SL": False, "SC": False})
    return S.components(_scores(spark, folder), c).select("score_id", *[nudged(F.col(f"{k}_score")).alias(f"{k}_score") for k in ("SL", "ZB", "SC")], "NO_score")


_S0 = " + ".join(f"{w} * {_squash_sql(k)}" for k, w in S.WEIGHTS.items())
_FLAGS = "least(1, greatest(0, (" + " + ".join(f"coalesce({f}, 0)" for f in S.FLAGS) + ") / 3.0))"
SEVERITY = _SEV = f"least(1, greatest(0, 0.85 * ({_S0}) + 0.10 * {_FLAGS}))"


@add("severity_blend", f"WITH {ONCE} SELECT score_id, {r6(_S0)} AS Severity_S0, {r6(_SEV)} AS Severity_final FROM once")
def severity_blend(spark: SparkSession, folder: str) -> DataFrame:
    return S.severity(_scores(spark, folder)).select("score_id", nudged(F.col("Severity_S0")).alias("Severity_S0"), nudged(F.col("Severity_final")).alias("Severity_final"))


_LABEL = "CASE WHEN {x} < 0.3 THEN 'Low' WHEN {x} < 0.7 THEN 'Medium' ELSE 'High' END"


@add("severity_labels", f"WITH {ONCE} SELECT {_LABEL.format(x=_SEV)} AS Severity_label, count(*) AS n FROM once GROUP BY 1")
def severity_labels(spark: SparkSession, folder: str) -> DataFrame:
    return S.severity(_scores(spark, folder)).groupBy("Severity_label").agg(F.count("*").alias("n"))


@add("severity_with_persistence", f"WITH {ONCE} SELECT score_id, {r6('least(1, greatest(0, 0.85 * tanh(abs(SL_z_score) / 3.0) + 0.05 * least(1, greatest(0, ' + NUM.format(c='Severity_final') + '))))')} AS severity FROM once")
def severity_with_persistence(spark: SparkSession, folder: str) -> DataFrame:
    c = S.Config.of({"columns": {"SL": "SL_z_score"}, "weights": {"SL": 2.0}, "flags": ("no_such_flag",)}, persistence="Severity_final")
    return S.severity(_scores(spark, folder), c, "severity", "label").select("score_id", nudged(F.col("severity")).alias("severity"))


@add("score_summary", f"WITH {FINITE} SELECT count(s) AS n, min(s) AS min, max(s) AS max, {r6('avg(s)')} AS mean, {r6('var_pop(s)')} AS var FROM fin")
def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    return S.summary(_finite(spark, folder), "s").withColumns({c: nudged(F.col(c)) for c in ("mean", "var")})


PCT = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@add("score_percentiles", f"WITH {FINITE} SELECT " + ", ".join(f"{r6(f'quantile_cont(s, {q})')} AS {n}" for n, q in PCT.items()) + " FROM fin")
def score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return S.percentiles(_finite(spark, folder), "s", PCT).select(*[nudged(F.col(c)).alias(c) for c in PCT])


@add(
    "operating_points",
    f"WITH {FINITE}, q AS (SELECT unnest(['p95', 'p99']) AS point, unnest([quantile_cont(s, 0.95), quantile_cont(s, 0.99)]) AS t FROM fin) SELECT point, {r6('any_value(t)')} AS threshold, {r6('avg(CASE WHEN s >= t THEN 1.0 ELSE 0 END)')} AS share FROM fin, q GROUP BY point",
)
def operating_points(spark: SparkSession, folder: str) -> DataFrame:
    return S.operating_points(_finite(spark, folder), "s", {"p95": 0.95, "p99": 0.99}).withColumns({c: nudged(F.col(c)) for c in ("threshold", "share")})


@add("share_above_threshold", f"WITH {FINITE} SELECT app_id, {r6('avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0 END)')} AS share FROM fin GROUP BY app_id")
def share_above_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _finite(spark, folder).groupBy("app_id").agg(nudged(F.avg(F.when(F.col("s") >= 0.5, 1.0).otherwise(0.0))).alias("share"))


@add("score_histogram", f"WITH {FINITE}, e AS (SELECT min(s) AS a, max(s) AS b FROM fin) SELECT CAST(least(floor((s - a) / ((b - a) / 50)), 49) AS INT) AS bin, count(*) AS n FROM fin, e GROUP BY 1")
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return S.histogram(_finite(spark, folder), "s")


@add(
    "batch_severity",
    f"""WITH {FINITE}, r AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS i, count(*) OVER () AS n FROM fin)
    SELECT 'topk' AS method, {r6('avg(s)')} AS severity FROM r WHERE i <= greatest(50, floor(0.01 * n)) UNION ALL SELECT 'percentile', {r6('avg(s)')} FROM fin WHERE s >= (SELECT quantile_cont(s, 0.99) FROM fin)
    UNION ALL SELECT 'threshold', {r6('avg(s)')} FROM fin WHERE s >= 0.7 UNION ALL SELECT 'mean', {r6('avg(s)')} FROM fin""",
)
def batch_severity(spark: SparkSession, folder: str) -> DataFrame:
    rows = _finite(spark, folder)
    one = lambda m: S.batch_severity(rows, "s", m, threshold=0.7).select(F.lit(m).alias("method"), nudged(F.col("severity")).alias("severity"))
    out = one("topk")
    for m in ("percentile", "threshold", "mean"):
        out = out.unionByName(one(m))
    return out


@add("topk_scores", f"WITH {FINITE} SELECT score_id, device_id, s FROM fin ORDER BY s DESC, score_id LIMIT 100")
def topk_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The feature is the report of the top 100."""
    return _finite(spark, folder).select("score_id", "device_id", "s").orderBy(F.col("s").desc(), "score_id").limit(100)


@add("data_profile", f"WITH {ONCE} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(CASE WHEN isfinite({c}) THEN 1 END) AS n, {r6(f'avg(CASE WHEN isfinite({c}) THEN {c} END)')} AS mean, {r6(f'stddev_pop(CASE WHEN isfinite({c}) THEN {c} END)')} AS std FROM once" for c in ("SC_z_score_session_cnt", "SS_z_score_max", "SL_z_score", "Severity_final")))
def data_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = S.profile(_scores(spark, folder), ["SC_z_score_session_cnt", "SS_z_score_max", "SL_z_score", "Severity_final"])
    return out.withColumns({c: nudged(F.col(c)) for c in ("mean", "std")})


def _daily_sql(name: str, cond: str) -> str:
    return f"WITH d AS (SELECT CAST(date AS DATE) AS date, count(DISTINCT device_id) AS {name} FROM severity_scores WHERE {cond} GROUP BY 1) SELECT date, {name}, {r6(f'avg({name}) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS {name}_rolling FROM d"


@add("daily_severe_devices", _daily_sql("devices_severe", "Severity_final >= 0.7 AND NOT isnan(Severity_final)"))
def daily_severe_devices(spark: SparkSession, folder: str) -> DataFrame:
    out = S.severe_devices(table(spark, folder, "severity_scores"), day(), "device_id", "Severity_final")
    return out.withColumn("devices_severe_rolling", nudged(F.col("devices_severe_rolling")))


@add("daily_flagged_devices", _daily_sql("devices_flagged", " OR ".join(f"abs({NUM.format(c=c)}) >= 3" for c in S.COLUMNS.values())))
def daily_flagged_devices(spark: SparkSession, folder: str) -> DataFrame:
    out = S.flagged_devices(table(spark, folder, "severity_scores"), day(), "device_id", list(S.COLUMNS.values()))
    return out.withColumn("devices_flagged_rolling", nudged(F.col("devices_flagged_rolling")))


@add("device_trend", "SELECT DISTINCT ON (score_id) device_id, date, hour, Severity_final, SL_z_score FROM severity_scores WHERE device_id = 39598327")
def device_trend(spark: SparkSession, folder: str) -> DataFrame:
    return S.trend(_scores(spark, folder), "device_id", 39598327, ["Severity_final", "SL_z_score", "no_such_component"])


@add("value_counts", "SELECT Severity_label, count(*) AS n FROM severity_scores WHERE Severity_label IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "severity_scores").where("Severity_label IS NOT NULL").groupBy("Severity_label").agg(F.count("*").alias("n"))


@add("app_flag_sums", "SELECT app_id, CAST(sum(AnomalySessionCount) AS BIGINT) AS frequent, CAST(sum(shortSessionAnomaly) AS BIGINT) AS short, CAST(sum(ZerobytesUsagenAnomaly) AS BIGINT) AS zero, count(DISTINCT device_id) AS devices FROM hourly_features GROUP BY app_id")
def app_flag_sums(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "hourly_features").groupBy("app_id").agg(F.sum("AnomalySessionCount").alias("frequent"), F.sum("shortSessionAnomaly").alias("short"), F.sum("ZerobytesUsagenAnomaly").alias("zero"), F.count_distinct("device_id").alias("devices"))


HF = "hf AS (SELECT DISTINCT ON (feature_id) * FROM hourly_features)"
_CAUSE = "concat_ws(', ', CASE WHEN shortSessionAnomaly = 1 THEN 'ShortSession' END, CASE WHEN ZerobytesUsagenAnomaly = 1 THEN 'ZeroByteSession' END)"
_WHEN = "strftime(CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) + CAST(hour AS INT) * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')"
_NORMAL = {
    "ShortSession": "CAST(trunc(coalesce(CASE WHEN shortSessionAnomaly = 0 THEN CAST(max_shortLength AS DOUBLE) END, expanding_mean_max_shortLength, 0)) AS BIGINT)",
    "ZeroByteSession": "CAST(trunc(coalesce(CASE WHEN ZerobytesUsagenAnomaly = 0 THEN CAST(max_zero_bytes_Count AS DOUBLE) END, CASE WHEN rolling_mean_zero_bytes_Count > 5 THEN 5 ELSE rolling_mean_zero_bytes_Count END, 0)) AS BIGINT)",
}
_UNUSUAL = {k: f"coalesce(CASE WHEN {f} = 1 THEN {c} ELSE AnomalySessionCount END, 0)" for k, (f, c, _) in A.CAUSES.items()}
_ANY = "(AnomalySessionCount = 1 OR shortSessionAnomaly = 1 OR ZerobytesUsagenAnomaly = 1 OR sessionTimeAnomalyBasedOnHistory = 1)"


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "hourly_features"), "feature_id")


def _anomaly():
    return (F.col("AnomalySessionCount") == 1) | (F.col("shortSessionAnomaly") == 1) | (F.col("ZerobytesUsagenAnomaly") == 1) | (F.col("sessionTimeAnomalyBasedOnHistory") == 1)


@add("anomaly_cause_label", f"WITH {HF} SELECT feature_id, {_CAUSE} AS AnomalyCause, 60 AS DurationInMin, {_WHEN} AS AnomalyEventTime FROM hf")
def anomaly_cause_label(spark: SparkSession, folder: str) -> DataFrame:
    return A.labelled(_features(spark, folder)).select("feature_id", "AnomalyCause", "DurationInMin", "AnomalyEventTime")


@add("cause_counts", f"WITH {HF} SELECT feature_id, " + ", ".join(f"{_NORMAL[k]} AS NormalSessionCount_{k}, {_UNUSUAL[k]} AS AnomalySessionCount_{k}" for k in A.CAUSES) + " FROM hf")
def cause_counts(spark: SparkSession, folder: str) -> DataFrame:
    return A.labelled(_features(spark, folder)).select("feature_id", *[f"{w}SessionCount_{k}" for k in A.CAUSES for w in ("Normal", "Anomaly")])


_ALERTS = f"""alerts AS (SELECT device_id AS DeviceId, app_id AS AppId, AnomalyCause, CASE AnomalyCause WHEN 'ShortSession' THEN ns ELSE nz END AS NormalSessionCount, CASE AnomalyCause WHEN 'ShortSession' THEN us ELSE uz END AS AnomalySessionCount,
    60 AS DurationInMin, CASE WHEN AnomalyCause <> 'ZeroByteSession' THEN CAST(trunc(AvgSessionLengthTime) AS INT) END AS AvgSessionLengthTime, AnomalyEventTime
    FROM (SELECT *, unnest(string_split({_CAUSE}, ', ')) AS AnomalyCause, {_NORMAL['ShortSession']} AS ns, {_NORMAL['ZeroByteSession']} AS nz, {_UNUSUAL['ShortSession']} AS us, {_UNUSUAL['ZeroByteSession']} AS uz, {_WHEN} AS AnomalyEventTime FROM hf WHERE {_ANY} AND {_CAUSE} <> ''))"""


@add("alert_explode", f"WITH {HF}, {_ALERTS} SELECT * FROM alerts")
def alert_explode(spark: SparkSession, folder: str) -> DataFrame:
    return A.exploded(_features(spark, folder), _anomaly())


@add("alert_batches_json")
def alert_batches_json(spark: SparkSession, folder: str) -> DataFrame:
    return batches(A.exploded(_features(spark, folder), _anomaly()), [F.col("DeviceId"), F.col("AnomalyEventTime"), F.col("AnomalyCause"), F.col("AppId")])


@add("alert_batch_sizes", f"WITH {HF}, {_ALERTS}, p AS (SELECT (row_number() OVER () - 1) // 1000 AS batch FROM alerts) SELECT CAST(batch AS INT) AS batch, count(*) AS records FROM p GROUP BY 1")
def alert_batch_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return alert_batches_json(spark, folder).select("batch", "records")


@add(
    "alert_causes",
    """SELECT CASE lower(c) WHEN 'shortsession' THEN 'ShortSession' WHEN 'zerobytesession' THEN 'ZeroByteSession' ELSE c END AS AnomalyCause, count(*) AS n, count(DISTINCT DeviceId) AS devices
    FROM (SELECT DeviceId, trim(unnest(string_split(AnomalyCause, ','))) AS c FROM (SELECT DISTINCT * FROM alert_records)) GROUP BY 1""",
)
def alert_causes(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.read_causes(table(spark, folder, "alert_records").distinct())
    return rows.groupBy("AnomalyCause").agg(F.count("*").alias("n"), F.count_distinct("DeviceId").alias("devices"))


@add(
    "impute_mean",
    f"""WITH {HF}, m AS (SELECT app_id, avg(expanding_mean_session_count) AS a, avg(rolling_mean_zero_bytes_Count) AS b FROM hf GROUP BY app_id)
    SELECT feature_id, {r6('coalesce(expanding_mean_session_count, a, 0)')} AS expanding_mean_session_count, {r6('coalesce(rolling_mean_zero_bytes_Count, b, 0)')} AS rolling_mean_zero_bytes_Count
    FROM hf JOIN m ON hf.app_id IS NOT DISTINCT FROM m.app_id""",
)
def impute_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls to the mean of the app, then 0. The means are one row per app; only they are joined, not windowed over an app's rows."""
    cols = ["expanding_mean_session_count", "rolling_mean_zero_bytes_Count"]
    rows = written(_features(spark, folder).select("feature_id", "app_id", *cols), "features")
    means = rows.groupBy(F.col("app_id").alias("_a")).agg(*[F.avg(c).alias(f"_{c}") for c in cols])
    out = rows.join(means, F.col("app_id").eqNullSafe(F.col("_a")))
    return out.select("feature_id", *[nudged(F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(0.0))).alias(c) for c in cols])
