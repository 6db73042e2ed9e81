"""Queries of the hourly session features and their history."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions.clean import day, hour, once
from lodestream.operators import hourly as H
from lodestream.operators.ordered import interpolated
from lodestream.plans.registry import Registry, table
from lodestream.scratch import root, written
from lodestream.sources import readers, sinks

REGISTRY = Registry()
add = REGISTRY.add

#: The hour at which the hourly job of the test data runs.
JOB = "2025-02-05 12:34:56"
STATS = ["session_count", "max_shortLength", "session_time"]


def r6(x: str) -> str:
    """The SQL of :func:`lodestream.operators.hourly.nudged`."""
    return f"round({x} + 1e-9, 6)"


EVENTS = """ev AS (SELECT app_id, device_id, event_date, record_type, session_id, min(input_bytes) AS input_bytes, min(output_bytes) AS output_bytes,
    min(CASE WHEN NOT isnan(session_time) THEN session_time END) AS session_time FROM session_events GROUP BY ALL)"""
HOURS = EVENTS + """, hours AS (SELECT app_id, device_id, CAST(event_date AS DATE) AS day, CAST(hour(event_date) AS INT) AS hr, count(DISTINCT session_id) AS session_count,
    count(CASE WHEN trunc(session_time) <= 60 THEN 1 END) AS max_shortLength, avg(CASE WHEN trunc(session_time) <= 60 THEN session_time END) AS AvgSessionLengthTime,
    avg(session_time) AS session_time, count(CASE WHEN input_bytes + output_bytes = 0 THEN 1 END) AS max_zero_bytes_Count FROM ev GROUP BY ALL)"""
_BEFORE = "OVER (PARTITION BY app_id, device_id ORDER BY day, hr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_RECENT = "OVER (PARTITION BY app_id, device_id ORDER BY day, hr ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
STATED = HOURS + ", stated AS (SELECT *, " + ", ".join(f"coalesce(avg({c}) {_BEFORE}, 0) AS m_{c}, coalesce(stddev_pop({c}) {_BEFORE}, 0) AS s_{c}" for c in STATS) + " FROM hours)"
_K = "app_id, device_id, day, hr"


def _flag(c: str) -> str:
    return f"CASE WHEN abs(({c} - m_{c}) / nullif(s_{c}, 0)) > 3 AND abs({c} - m_{c}) > 4 THEN 1 ELSE 0 END"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "session_events")


def _hours(spark: SparkSession, folder: str) -> DataFrame:
    return H.hourly(_events(spark, folder))


def _stated(spark: SparkSession, folder: str) -> DataFrame:
    return H.expanding(_hours(spark, folder), STATS)


@add("parquet_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def parquet_scan(spark: SparkSession, folder: str) -> DataFrame:
    return readers.parquet(spark, f"{folder}/nation.parquet", "n_regionkey = 1").select("n_nationkey", "n_name", "n_regionkey")


@add("parquet_glob", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'region', count(*) FROM region")
def parquet_glob(spark: SparkSession, folder: str) -> DataFrame:
    count = lambda name, pattern: readers.parquet(spark, f"{folder}/{pattern}").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("part", "part.parquet*").unionByName(count("region", "regio*.parquet"))


@add("catalog_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def catalog_scan(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "supplier").createOrReplaceTempView("lodestream_supplier")
    return readers.catalog(spark, "lodestream_supplier", "s_acctbal > 0").select("s_suppkey", "s_name")


@add("empty_fallback", "SELECT app_id, device_id, date FROM history_snapshot WHERE false")
def empty_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A history that has not been written yet."""
    return readers.or_empty(spark, lambda: readers.parquet(spark, f"{folder}/no_such_history.parquet"), "app_id long, device_id long, date string")


@add("stream_decode", "SELECT event_id, user_id, event_type FROM events")
def stream_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Records as a stream hands them over (base64 of JSON), read back into columns."""
    raw = table(spark, folder, "events").select(F.base64(F.to_json(F.struct("event_id", "user_id", "event_type")).cast("binary")).alias("data"))
    return readers.decoded(raw, "data", "event_id long, user_id long, event_type string")


_AT = "make_timestamp(year, month, day, hour, 0, 0)"


@add(
    "scan_filter_hour",
    f"""SELECT app_id, device_id, event_date, record_type, session_id FROM session_events WHERE {_AT} BETWEEN TIMESTAMP '2025-02-05 11:00:00' AND TIMESTAMP '2025-02-05 12:00:00'
    AND event_date >= TIMESTAMP '2025-02-05 11:00:00' AND event_date < TIMESTAMP '2025-02-05 12:00:00'""",
)
def scan_filter_hour(spark: SparkSession, folder: str) -> DataFrame:
    return H.arrived(_events(spark, folder), JOB).select("app_id", "device_id", "event_date", "record_type", "session_id")


@add("dedupe_events", f"WITH {EVENTS} SELECT * FROM ev")
def dedupe_events(spark: SparkSession, folder: str) -> DataFrame:
    return H.once(_events(spark, folder))


@add("distinct_rows", "SELECT DISTINCT app_id, device_id, record_type, session_type FROM session_events")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("app_id", "device_id", "record_type", "session_type").distinct()


@add("usage_projection", "SELECT app_id AS app, CAST(device_id AS VARCHAR) AS device, CAST(event_date AS DATE) AS date, CAST(hour(event_date) AS INT) AS hour, input_bytes + output_bytes AS bytes_usage FROM session_events")
def usage_projection(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder).withColumn("bytes_usage", F.col("input_bytes") + F.col("output_bytes"))
    rows = rows.select("app_id", F.col("device_id").cast("string").alias("device"), F.to_date("event_date").alias("date"), F.hour("event_date").alias("hour"), "bytes_usage")
    return rows.withColumnRenamed("app_id", "app")


@add("hourly_aggregates", f"WITH {HOURS} SELECT {_K}, session_count, max_shortLength, {r6('AvgSessionLengthTime')} AS AvgSessionLengthTime, {r6('session_time')} AS session_time, max_zero_bytes_Count FROM hours")
def hourly_aggregates(spark: SparkSession, folder: str) -> DataFrame:
    return _hours(spark, folder).withColumns({c: H.nudged(F.col(c)) for c in ("AvgSessionLengthTime", "session_time")})


@add(
    "hourly_merge_outer",
    f"""WITH {EVENTS}, base AS (SELECT *, CAST(event_date AS DATE) AS day, CAST(hour(event_date) AS INT) AS hr FROM ev WHERE app_id IS NOT NULL AND device_id IS NOT NULL),
    a AS (SELECT {_K}, count(DISTINCT session_id) AS sessions FROM base GROUP BY ALL), b AS (SELECT {_K}, count(*) AS shorts FROM base WHERE trunc(session_time) <= 60 GROUP BY ALL),
    c AS (SELECT {_K}, count(*) AS timed FROM base WHERE session_time IS NOT NULL GROUP BY ALL), d AS (SELECT {_K}, count(*) AS zeros FROM base WHERE input_bytes + output_bytes = 0 GROUP BY ALL)
    SELECT * FROM a FULL JOIN b USING ({_K}) FULL JOIN c USING ({_K}) FULL JOIN d USING ({_K})""",
)
def hourly_merge_outer(spark: SparkSession, folder: str) -> DataFrame:
    """Four frames of the same keys, merged; events move once, by the keys, and the joins add no shuffle of their own."""
    rows = _events(spark, folder).where(F.col("app_id").isNotNull() & F.col("device_id").isNotNull())
    rows = rows.withColumns({"day": F.to_date("event_date"), "hr": F.hour("event_date")})
    rows = H.once(rows.select(*H.REPEAT, "day", "hr", "input_bytes", "output_bytes", "session_time").repartition(*H.KEYS), ["day", "hr"])
    part = lambda name, cond, agg=None: rows.where(cond).groupBy(*H.KEYS).agg((agg if agg is not None else F.count("*")).alias(name))
    out = part("sessions", F.lit(True), F.count_distinct("session_id"))
    for other in (part("shorts", F.col("session_time").cast("int") <= 60), part("timed", F.col("session_time").isNotNull()), part("zeros", F.col("input_bytes") + F.col("output_bytes") == 0)):
        out = out.join(other, H.KEYS, "full")
    return out


@add("expanding_stats", f"WITH {STATED} SELECT {_K}, " + ", ".join(f"{r6(f'm_{c}')} AS expanding_mean_{c}, {r6(f's_{c}')} AS expanding_std_{c}" for c in STATS) + " FROM stated")
def expanding_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _stated(spark, folder).select(*H.KEYS, *[H.nudged(F.col(f"expanding_{s}_{c}")).alias(f"expanding_{s}_{c}") for c in STATS for s in ("mean", "std")])


_LAST = f"last_hours AS (SELECT * FROM hours WHERE app_id IS NOT NULL AND device_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY app_id, device_id ORDER BY day DESC, hr DESC) = 1)"


def _new_sql(source: str, name: str) -> str:
    """Old (m, s, n) and new (mn, sn, nn) statistics of each column of ``source``."""
    old = ", ".join(f"coalesce(prev_mean_{c}, 0) AS m_{c}, coalesce(prev_std_{c}, 0) AS s_{c}, coalesce(prev_count_{c}, 0) AS n_{c}" for c in STATS)
    mean = ", ".join(f"CASE WHEN {c} IS NULL THEN m_{c} ELSE (m_{c} * n_{c} + {c}) / (n_{c} + 1) END AS mn_{c}" for c in STATS)
    rest = ", ".join(f"CASE WHEN {c} IS NULL THEN s_{c} ELSE sqrt((s_{c} * s_{c} * n_{c} + ({c} - m_{c}) * ({c} - mn_{c})) / (n_{c} + 1)) END AS sn_{c}, n_{c} + CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS nn_{c}" for c in STATS)
    return f"{name} AS (SELECT *, {rest} FROM (SELECT *, {mean} FROM (SELECT l.*, {old} FROM {source} l LEFT JOIN history_snapshot h USING (app_id, device_id))))"


_NEW = _new_sql("last_hours", "upd")
_PREV = [f"prev_{s}_{c}" for c in STATS for s in ("mean", "std", "count")]
_PREV_NEW = ", ".join(f"{r6(f'mn_{c}')} AS prev_mean_{c}, {r6(f'sn_{c}')} AS prev_std_{c}, nn_{c} AS prev_count_{c}" for c in STATS)
_PREV_OLD = ", ".join(p if p.startswith("prev_count") else r6(p) for p in _PREV)


def _shown(history: DataFrame) -> DataFrame:
    return history.withColumns({c: H.nudged(F.col(c)) for c in _PREV if not c.startswith("prev_count")})


def _last_hours(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy(*H.DEVICE).orderBy(F.col("day").desc(), F.col("hr").desc())
    rows = _hours(spark, folder).where(F.col("app_id").isNotNull() & F.col("device_id").isNotNull())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    return H.advanced(_last_hours(spark, folder), table(spark, folder, "history_snapshot"), STATS)


@add("incremental_stats", f"WITH {HOURS}, {_LAST}, {_NEW} SELECT {_K}, {r6('m_session_count')} AS old_mean, {r6('mn_session_count')} AS new_mean, {r6('sn_session_count')} AS new_std, nn_session_count AS new_count FROM upd")
def incremental_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows, c = _incremental(spark, folder), "session_count"
    return rows.select(*H.KEYS, H.nudged(F.col(f"expanding_mean_{c}")).alias("old_mean"), H.nudged(F.col(f"prev_mean_{c}")).alias("new_mean"), H.nudged(F.col(f"prev_std_{c}")).alias("new_std"), F.col(f"prev_count_{c}").alias("new_count"))


@add(
    "history_upsert",
    f"""WITH {HOURS}, {_LAST}, {_NEW} SELECT app_id, device_id, strftime(day, '%Y-%m-%d') AS date, lpad(CAST(hr AS VARCHAR), 2, '0') AS hour, {_PREV_NEW} FROM upd
    UNION ALL SELECT app_id, device_id, date, hour, {_PREV_OLD} FROM history_snapshot ANTI JOIN upd USING (app_id, device_id)""",
)
def history_upsert(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["app_id", "device_id", "date", "hour", *_PREV]
    stamp = {"date": F.date_format("day", "yyyy-MM-dd"), "hour": F.format_string("%02d", "hr")}
    new = _incremental(spark, folder).withColumns(stamp).select(*cols)
    return _shown(H.upserted(table(spark, folder, "history_snapshot").select(*cols), new))


@add("history_latest", "SELECT * EXCLUDE (prev_mean_session_time, prev_std_session_time, prev_mean_session_count, prev_std_session_count, prev_mean_max_shortLength, prev_std_max_shortLength) FROM (SELECT DISTINCT * FROM history_snapshot) QUALIFY row_number() OVER (PARTITION BY app_id, device_id ORDER BY prev_count_session_count DESC, date DESC, hour DESC) = 1")
def history_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = H.latest_history(table(spark, folder, "history_snapshot"))
    return rows.drop(*[f"prev_{s}_{c}" for s in ("mean", "std") for c in STATS])


LAST_AT = "CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) + CAST(hour AS INT) * INTERVAL 1 HOUR"


@add("history_asof", f"SELECT app_id, device_id, max_zero_bytes_Count FROM last_n_features WHERE {LAST_AT} = (SELECT max({LAST_AT}) FROM last_n_features WHERE {LAST_AT} < TIMESTAMP '2025-03-05 00:00:00')")
def history_asof(spark: SparkSession, folder: str) -> DataFrame:
    rows = readers.latest_before(table(spark, folder, "last_n_features"), day(), hour(), F.lit("2025-03-05 00:00:00").cast("timestamp_ntz"))
    return rows.select("app_id", "device_id", "max_zero_bytes_Count")


@add("last_n_hours", f"SELECT app_id, device_id, {LAST_AT} AS event_hour, max_zero_bytes_Count FROM last_n_features WHERE {LAST_AT} >= TIMESTAMP '2025-03-05 05:00:00' AND {LAST_AT} < TIMESTAMP '2025-03-05 12:00:00'")
def last_n_hours(spark: SparkSession, folder: str) -> DataFrame:
    """The seven hours before a job, from rows whose hours are not written alike."""
    at = F.make_timestamp_ntz(F.year(day()), F.month(day()), F.dayofmonth(day()), hour(), F.lit(0), F.lit(0))
    end = F.lit("2025-03-05 12:00:00").cast("timestamp_ntz")
    rows = table(spark, folder, "last_n_features").select("app_id", "device_id", at.alias("event_hour"), "max_zero_bytes_Count")
    return rows.where((F.col("event_hour") >= end - F.expr("INTERVAL 7 HOURS")) & (F.col("event_hour") < end))


@add("history_semi_join", "SELECT h.app_id, h.device_id, prev_count_session_count FROM history_snapshot h SEMI JOIN (SELECT DISTINCT app_id, device_id FROM session_events) USING (app_id, device_id)")
def history_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "history_snapshot").join(_events(spark, folder).select(*H.DEVICE), H.DEVICE, "left_semi").select(*H.DEVICE, "prev_count_session_count")


@add("frequent_flag", f"WITH {STATED} SELECT {_K}, session_count, {_flag('session_count')} AS AnomalySessionCount FROM stated")
def frequent_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _stated(spark, folder).select(*H.KEYS, "session_count", H.two_sided("session_count").alias("AnomalySessionCount"))


@add("short_flag", f"WITH {STATED} SELECT {_K}, max_shortLength, {r6('AvgSessionLengthTime')} AS AvgSessionLengthTime, {_flag('max_shortLength')} AS shortSessionAnomaly FROM stated")
def short_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _stated(spark, folder).select(*H.KEYS, "max_shortLength", H.nudged(F.col("AvgSessionLengthTime")).alias("AvgSessionLengthTime"), H.two_sided("max_shortLength").alias("shortSessionAnomaly"))


_LIMITS = ", limits AS (SELECT quantile_cont(session_time - m_session_time, 0.95) AS high, quantile_cont(session_time - m_session_time, 0.10) AS low FROM stated)"
_TIME_FLAG = "CASE WHEN ((session_time - m_session_time) / nullif(s_session_time, 0) > 3 AND session_time - m_session_time > high) OR ((session_time - m_session_time) / nullif(s_session_time, 0) < -1 AND session_time - m_session_time < low) THEN 1 ELSE 0 END"


def _limits(rows: DataFrame) -> DataFrame:
    diff = rows.select((F.col("session_time") - F.col("expanding_mean_session_time")).alias("diff"))
    return interpolated(diff, [], "diff", {"high": 0.95, "low": 0.10}).select("high", "low")


@add("session_time_percentiles", f"WITH {STATED}{_LIMITS} SELECT {r6('high')} AS high, {r6('low')} AS low FROM limits")
def session_time_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return _limits(_stated(spark, folder)).select(H.nudged(F.col("high")).alias("high"), H.nudged(F.col("low")).alias("low"))


@add("session_time_flag_exact", f"WITH {STATED}{_LIMITS} SELECT {_K}, {_TIME_FLAG} AS sessionTimeAnomalyBasedOnHistory FROM stated, limits")
def session_time_flag_exact(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(_stated(spark, folder), "stated")
    rows = rows.crossJoin(F.broadcast(_limits(rows)))  # one row
    return rows.select(*H.KEYS, H.asymmetric("session_time", F.col("high"), F.col("low")).alias("sessionTimeAnomalyBasedOnHistory"))


@add("zero_usage_rolling", f"WITH {HOURS} SELECT {_K}, max_zero_bytes_Count, {r6(f'coalesce(avg(nullif(max_zero_bytes_Count, 0)) {_RECENT}, 0)')} AS rolling_mean_zero_bytes_Count, CASE WHEN max_zero_bytes_Count > 5 THEN 1 ELSE 0 END AS ZerobytesUsagenAnomaly FROM hours")
def zero_usage_rolling(spark: SparkSession, folder: str) -> DataFrame:
    rows = H.zero_usage(_hours(spark, folder))
    return rows.select(*H.KEYS, "max_zero_bytes_Count", H.nudged(F.col("rolling_mean_zero_bytes_Count")).alias("rolling_mean_zero_bytes_Count"), "ZerobytesUsagenAnomaly")


@add(
    "zero_usage_with_last_n",
    f"""WITH {HOURS}, {_LAST}, both_ AS (SELECT app_id, device_id, day, hr, nullif(max_zero_bytes_Count, 0) AS x, 1 AS fresh FROM last_hours
    UNION ALL SELECT app_id, device_id, CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE), CAST(hour AS INT), max_zero_bytes_Count, 0 FROM last_n_features),
    r AS (SELECT *, {r6('avg(x) OVER (PARTITION BY app_id, device_id ORDER BY day, hr, fresh ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)')} AS rolling, stddev_pop(x) OVER (PARTITION BY app_id, device_id ORDER BY day, hr, fresh ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS spread FROM both_)
    SELECT app_id, device_id, day, hr, x, rolling, {r6('spread')} AS spread FROM r WHERE fresh = 1""",
)
def zero_usage_with_last_n(spark: SparkSession, folder: str) -> DataFrame:
    """The newest hour of each device over its last seven stored ones: union, then the rolling window, then the newest hour only."""
    new = _last_hours(spark, folder).select(*H.KEYS, F.nullif(F.col("max_zero_bytes_Count"), F.lit(0)).alias("x"), F.lit(1).alias("fresh"))
    old = table(spark, folder, "last_n_features").select("app_id", "device_id", day().alias("day"), hour().alias("hr"), F.col("max_zero_bytes_Count").alias("x"), F.lit(0).alias("fresh"))
    recent = Window.partitionBy(*H.DEVICE).orderBy("day", "hr", "fresh").rowsBetween(-7, 0)
    rows = new.unionByName(old).withColumns({"rolling": H.nudged(F.avg("x").over(recent)), "spread": H.nudged(F.stddev_pop("x").over(recent))})
    return rows.where("fresh = 1").drop("fresh")


@add(
    "lag_last_nonnull",
    f"""WITH {HOURS}, p AS (SELECT {_K}, max_zero_bytes_Count AS x, lag(nullif(max_zero_bytes_Count, 0)) OVER w AS prev_value FROM hours WINDOW w AS (PARTITION BY app_id, device_id ORDER BY day, hr))
    SELECT {_K}, prev_value, last_value(prev_value IGNORE NULLS) OVER (PARTITION BY app_id, device_id ORDER BY day, hr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous_non_zero,
    count(x) OVER (PARTITION BY app_id, device_id ORDER BY day, hr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM p""",
)
def lag_last_nonnull(spark: SparkSession, folder: str) -> DataFrame:
    line = Window.partitionBy(*H.DEVICE).orderBy("day", "hr")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = _hours(spark, folder).withColumn("prev_value", F.lag(F.nullif(F.col("max_zero_bytes_Count"), F.lit(0))).over(line))
    return rows.select(*H.KEYS, "prev_value", F.last("prev_value", ignorenulls=True).over(so_far).alias("previous_non_zero"), F.count("max_zero_bytes_Count").over(so_far).alias("seen"))


@add("hour_sequence", "SELECT unnest(generate_series(TIMESTAMP '2025-02-05 05:00:00', TIMESTAMP '2025-02-05 12:00:00', INTERVAL 1 HOUR)) AS h")
def hour_sequence(spark: SparkSession, folder: str) -> DataFrame:
    end = F.date_trunc("hour", F.lit(JOB).cast("timestamp_ntz")).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(end - F.expr("INTERVAL 7 HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("h"))


@add(
    "hourly_features_job",
    f"""WITH {STATED}{_LIMITS} SELECT {_K}, session_count, {r6('m_session_count')} AS expanding_mean_session_count, {_flag('session_count')} AS AnomalySessionCount, max_shortLength, {r6('m_max_shortLength')} AS expanding_mean_max_shortLength,
    {_flag('max_shortLength')} AS shortSessionAnomaly, {r6('AvgSessionLengthTime')} AS AvgSessionLengthTime, {r6('session_time')} AS session_time, {r6('m_session_time')} AS expanding_mean_session_time, {_TIME_FLAG} AS sessionTimeAnomalyBasedOnHistory,
    max_zero_bytes_Count, {r6(f'coalesce(avg(nullif(max_zero_bytes_Count, 0)) {_RECENT}, 0)')} AS rolling_mean_zero_bytes_Count, CASE WHEN max_zero_bytes_Count > 5 THEN 1 ELSE 0 END AS ZerobytesUsagenAnomaly FROM stated, limits""",
)
def hourly_features_job(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: all events to hourly features, with exact percentiles for the session-time flag."""
    stated = written(_stated(spark, folder), "stated")
    rows = H.zero_usage(stated).crossJoin(F.broadcast(_limits(stated)))  # one row
    flags = {"AnomalySessionCount": H.two_sided("session_count"), "shortSessionAnomaly": H.two_sided("max_shortLength"), "sessionTimeAnomalyBasedOnHistory": H.asymmetric("session_time", F.col("high"), F.col("low"))}
    means = ["expanding_mean_session_count", "expanding_mean_max_shortLength", "AvgSessionLengthTime", "session_time", "expanding_mean_session_time", "rolling_mean_zero_bytes_Count"]
    out = rows.withColumns(flags).drop("high", "low", *[f"expanding_std_{c}" for c in STATS])
    return out.withColumns({c: H.nudged(F.col(c)) for c in means})


#: A late hour, for which the stored last hours of the test data are recent.
LATE_JOB = "2025-03-05 12:10:00"
_THE_HOUR = HOURS.replace("FROM session_events GROUP BY ALL", f"FROM session_events WHERE {_AT} BETWEEN TIMESTAMP '2025-03-05 11:00:00' AND TIMESTAMP '2025-03-05 12:00:00' AND event_date >= TIMESTAMP '2025-03-05 11:00:00' AND event_date < TIMESTAMP '2025-03-05 12:00:00' GROUP BY ALL")
_HOUR_NEW = _new_sql("hours", "stated")
_HOUR_ZERO = f"""zero_ AS (SELECT app_id, device_id, {r6('coalesce(avg(x) OVER (PARTITION BY app_id, device_id ORDER BY stamp ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0)')} AS rolling, fresh FROM
    (SELECT app_id, device_id, TIMESTAMP '2025-03-05 11:00:00' AS stamp, nullif(max_zero_bytes_Count, 0) AS x, 1 AS fresh FROM hours
    UNION ALL SELECT app_id, device_id, {LAST_AT}, nullif(max_zero_bytes_Count, 0), 0 FROM last_n_features WHERE {LAST_AT} < TIMESTAMP '2025-03-05 11:00:00'))"""


def _run_job(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    last_n = table(spark, folder, "last_n_features").select("app_id", "device_id", day().alias("day"), hour().alias("hr"), "max_zero_bytes_Count")
    return H.job(_events(spark, folder), H.latest_history(table(spark, folder, "history_snapshot")), last_n, LATE_JOB, _limits)


@add(
    "job_features",
    f"""WITH {_THE_HOUR}, {_HOUR_NEW}, {_HOUR_ZERO}{_LIMITS} SELECT app_id, device_id, '2025-03-05' AS date, '11' AS hour, session_count, {r6('m_session_count')} AS expanding_mean_session_count, {_flag('session_count')} AS AnomalySessionCount, max_shortLength,
    {r6('m_max_shortLength')} AS expanding_mean_max_shortLength, {_flag('max_shortLength')} AS shortSessionAnomaly, {r6('AvgSessionLengthTime')} AS AvgSessionLengthTime, {r6('session_time')} AS session_time, {r6('m_session_time')} AS expanding_mean_session_time,
    {_TIME_FLAG} AS sessionTimeAnomalyBasedOnHistory, max_zero_bytes_Count, rolling AS rolling_mean_zero_bytes_Count, CASE WHEN max_zero_bytes_Count > 5 THEN 1 ELSE 0 END AS ZerobytesUsagenAnomaly
    FROM stated s JOIN (SELECT * FROM zero_ WHERE fresh = 1) z ON s.app_id IS NOT DISTINCT FROM z.app_id AND s.device_id IS NOT DISTINCT FROM z.device_id, limits""".replace("SELECT app_id, device_id, '2025", "SELECT s.app_id, s.device_id, '2025"),
)
def job_features(spark: SparkSession, folder: str) -> DataFrame:
    """One run of the hourly job: the hour's events, the history and the last hours to features; no other event is read."""
    out = _run_job(spark, folder)[0]
    means = ["expanding_mean_session_count", "expanding_mean_max_shortLength", "AvgSessionLengthTime", "session_time", "expanding_mean_session_time", "rolling_mean_zero_bytes_Count"]
    return out.withColumns({c: H.nudged(F.col(c)) for c in means})


@add(
    "job_history",
    f"""WITH {_THE_HOUR}, {_HOUR_NEW}, known AS (SELECT * FROM stated WHERE app_id IS NOT NULL AND device_id IS NOT NULL) SELECT app_id, device_id, '2025-03-05' AS date, '11' AS hour, {_PREV_NEW} FROM known
    UNION ALL SELECT app_id, device_id, '2025-03-05', '11', {_PREV_OLD} FROM history_snapshot ANTI JOIN known USING (app_id, device_id)""",
)
def job_history(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_run_job(spark, folder)[1])


@add("isin_filter", "SELECT device_id, event_date, record_type FROM session_events WHERE hour IN (1, 2, 3)")
def isin_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Events that arrived in given hours: the list reaches the scan."""
    return readers.only(_events(spark, folder), "hour", [1, 2, 3]).select("device_id", "event_date", "record_type")


def _place(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid4().hex[:12]}"


@add("sink_partitioned", f"WITH {HOURS} SELECT app_id, device_id, CAST(day AS VARCHAR) AS date, lpad(CAST(hr AS VARCHAR), 2, '0') AS hour, session_count, max_zero_bytes_Count FROM hours WHERE app_id IS NOT NULL")
def sink_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """Features written below ``date=`` folders twice, as a repeated run would, and read back: nothing is doubled."""
    rows = _hours(spark, folder).where("app_id IS NOT NULL")
    out = rows.select("app_id", "device_id", F.col("day").cast("string").alias("date"), F.format_string("%02d", "hr").alias("hour"), "session_count", "max_zero_bytes_Count")
    path = _place(spark, "features")
    for _ in range(2):
        sinks.partitioned(out, path, ["date"], ["device_id", "hour"])
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


@add("sink_csv", "SELECT DISTINCT ON (score_id) score_id, Severity_final, Severity_label FROM severity_scores WHERE isfinite(Severity_final)")
def sink_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = once(table(spark, folder, "severity_scores").select("score_id", "Severity_final", "Severity_label"), "score_id")
    rows = rows.where("Severity_final IS NOT NULL AND NOT isnan(Severity_final) AND abs(Severity_final) < double('inf')")
    path = _place(spark, "scored")
    sinks.csv(rows, path)
    return readers.csv(spark, path, "score_id long, Severity_final double, Severity_label string")


@add("sink_runs", "SELECT 'sessions' AS run, unnest(['events', 'apps']) AS metric, unnest([(SELECT CAST(count(*) AS DOUBLE) FROM session_events), (SELECT CAST(count(DISTINCT app_id) AS DOUBLE) FROM session_events)]) AS value")
def sink_runs(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "runs")
    metrics = _events(spark, folder).agg(F.count("*").alias("events"), F.count_distinct("app_id").alias("apps"))
    sinks.log_run(metrics, path, "sessions", {"table": "session_events"})
    return spark.read.parquet(path).select("run", "metric", "value")


@add("text_source", "SELECT trim(n_name) AS value FROM nation")
def text_source(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus file of lines, blank ones among them, read back without those."""
    path = _place(spark, "corpus")
    names = table(spark, folder, "nation").select(F.col("n_name").alias("value"))
    names.unionByName(names.select(F.lit("  ").alias("value"))).write.text(path)
    return readers.lines(spark, path)


@add("fill_defaults", "SELECT feature_id, coalesce(max_zero_bytes_Count, 0) AS max_zero_bytes_Count, CASE WHEN session_time IS NULL OR isnan(session_time) THEN -1 ELSE session_time END AS session_time FROM hourly_features")
def fill_defaults(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hourly_features").select("feature_id", "max_zero_bytes_Count", "session_time")
    return rows.na.fill({"max_zero_bytes_Count": 0, "session_time": -1.0})
