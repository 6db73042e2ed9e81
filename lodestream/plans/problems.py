"""Queries p2, p3, p6 and p7 of the core problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.clean import day, hour, once
from lodestream.operators import balance, fill, spikes, trailing
from lodestream.plans.registry import Registry, table
from lodestream.scratch import written

REGISTRY = Registry()
add = REGISTRY.add

#: A key is heavy from this share of all rows.
HEAVY = 0.025
SUMS = ["max_zero_bytes_Count", "rolling_mean_zero_bytes_Count", "expanding_mean_session_count"]


@add(
    "p2_found",
    """SELECT 'app_id' AS key_name, app_id AS key_value FROM session_events WHERE app_id IS NOT NULL GROUP BY app_id
    HAVING count(*) >= 0.025 * (SELECT count(*) FROM session_events)
    UNION ALL SELECT 'device_id', device_id FROM session_events WHERE device_id IS NOT NULL GROUP BY device_id
    HAVING count(*) >= 0.025 * (SELECT count(*) FROM session_events)""",
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "session_events")
    one = lambda key: balance.heavy_keys(events, key, HEAVY).select(F.lit(key).alias("key_name"), F.col(key).alias("key_value"))
    return one("app_id").unionByName(one("device_id"))


def _key_results(events: DataFrame, key: str) -> DataFrame:
    seconds = F.when(~F.isnan("session_time"), F.col("session_time"))
    return balance.balanced_results(
        events, key,
        {"r": F.count("*"), "s": F.count_distinct("session_id"), "i": F.sum("input_bytes"), "o": F.sum("output_bytes"), "m": F.max(seconds), "n": F.count(seconds)},
        {"rows": F.sum("r"), "sessions": F.sum("s"), "input_bytes": F.sum("i"), "output_bytes": F.sum("o"), "longest_session": F.max("m"), "timed_rows": F.sum("n")},
        keep_together=["session_id"],
    )


def _key_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS rows, count(DISTINCT session_id) AS sessions, CAST(sum(input_bytes) AS BIGINT) AS input_bytes,
    CAST(sum(output_bytes) AS BIGINT) AS output_bytes, max(CASE WHEN NOT isnan(session_time) THEN session_time END) AS longest_session,
    count(CASE WHEN NOT isnan(session_time) THEN 1 END) AS timed_rows FROM session_events GROUP BY {key}"""


@add("p2_app_results", _key_sql("app_id"))
def p2_app_results(spark: SparkSession, folder: str) -> DataFrame:
    return _key_results(table(spark, folder, "session_events"), "app_id")


@add("p2_device_results", _key_sql("device_id"))
def p2_device_results(spark: SparkSession, folder: str) -> DataFrame:
    return _key_results(table(spark, folder, "session_events"), "device_id")


@add(
    "p2_history_join",
    """SELECT e.device_id, count(*) AS rows, count(CASE WHEN NOT isnan(e.session_time) AND e.session_time > h.prev_mean_session_time + 3 * h.prev_std_session_time THEN 1 END) AS long_rows
    FROM session_events e JOIN history_snapshot h ON e.device_id = h.device_id AND e.app_id = h.app_id GROUP BY e.device_id""",
)
def p2_history_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every event against its device's own history: the join is fragmented and replicated, the counts are small."""
    events = table(spark, folder, "session_events").select("app_id", "device_id", "session_time")
    history = table(spark, folder, "history_snapshot").select("app_id", "device_id", "prev_mean_session_time", "prev_std_session_time")
    joined = balance.balanced_join(events, history, "device_id", "inner", ["app_id"])
    long = ~F.isnan("session_time") & (F.col("session_time") > F.col("prev_mean_session_time") + 3 * F.col("prev_std_session_time"))
    return joined.groupBy("device_id").agg(F.count("*").alias("rows"), F.count(F.when(long, 1)).alias("long_rows"))


READINGS = [spikes.Reading("session_count"), spikes.Reading("session_time", high=86400.0, absent_below=0.0), spikes.Reading("max_zero_bytes_Count")]


def _flagged(spark: SparkSession, folder: str) -> DataFrame:
    hours = F.datediff("_day", F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.col("_hour")
    rows = table(spark, folder, "hourly_features").select("feature_id", "device_id", day().alias("_day"), hour().alias("_hour"), *[f.name for f in READINGS])
    return spikes.flagged(rows.withColumn("_t", hours), "feature_id", "device_id", "_t", READINGS)


#: Levels by sorting all readings; the normal one is the largest. The operator finds it by normality instead.
_P6 = """WITH once AS (SELECT DISTINCT ON (feature_id) feature_id, device_id, CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) + CAST(hour AS INT) * INTERVAL 1 HOUR AS t, session_count, session_time, max_zero_bytes_Count FROM hourly_features),
    r AS (SELECT feature_id, device_id, t, 'session_count' AS field, CAST(session_count AS DOUBLE) AS v FROM once WHERE session_count IS NOT NULL
        UNION ALL SELECT feature_id, device_id, t, 'session_time', session_time FROM once WHERE session_time >= 0 AND NOT isnan(session_time)
        UNION ALL SELECT feature_id, device_id, t, 'max_zero_bytes_Count', max_zero_bytes_Count FROM once WHERE max_zero_bytes_Count IS NOT NULL),
    c AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY device_id, field ORDER BY t) THEN 1 ELSE 0 END AS new FROM r),
    g AS (SELECT *, sum(new) OVER (PARTITION BY device_id, field ORDER BY t) AS run FROM c),
    f AS (SELECT *, count(*) OVER (PARTITION BY device_id, field, run) AS n FROM g),
    k AS (SELECT *, v < 0 OR isinf(v) OR (field = 'session_time' AND v > 86400) AS never, n >= 6 AND v <> 0 AS stuck FROM f),
    o AS (SELECT *, lag(v) OVER (PARTITION BY device_id, field ORDER BY v) AS p FROM k WHERE NOT never AND NOT stuck),
    l AS (SELECT *, sum(CASE WHEN v > 2 * p AND v > p + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, field ORDER BY v ROWS UNBOUNDED PRECEDING) AS level FROM o),
    m AS (SELECT device_id, field, level, min(v) AS lo, max(v) AS hi, count(*) AS many FROM l GROUP BY device_id, field, level QUALIFY row_number() OVER (PARTITION BY device_id, field ORDER BY many DESC) = 1)
    SELECT feature_id, field FROM k LEFT JOIN m USING (device_id, field) WHERE never OR stuck OR (v > 2 * hi AND v > hi + 10) OR (v < lo / 2 AND v < lo - 10)"""


@add("p6_found", _P6)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).where(F.col("reason").isNotNull()).select(F.col("id").alias("feature_id"), "field")


@add(
    "p6_reasons",
    _P6.rpartition("SELECT feature_id, field FROM k")[0]
    + "SELECT feature_id, field, v AS value, CAST(n AS BIGINT) AS run, CASE WHEN never THEN 'impossible' WHEN stuck THEN 'stuck' WHEN (v > 2 * hi AND v > hi + 10) OR (v < lo / 2 AND v < lo - 10) THEN 'spike' END AS reason FROM k LEFT JOIN m USING (device_id, field)",
)
def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading with its run and its reason, without the scores, which SQL cannot give."""
    return _flagged(spark, folder).select(F.col("id").alias("feature_id"), "field", "value", "run", "reason")


@add("p6_flagged")
def p6_flagged(spark: SparkSession, folder: str) -> DataFrame:
    return _flagged(spark, folder).withColumnsRenamed({"id": "feature_id", "entity": "device_id"})


def _trailing(spark: SparkSession, folder: str, measures: list[str]) -> DataFrame:
    rows = table(spark, folder, "hourly_features").withColumn("_day", day())
    return trailing.trailing_totals(rows, "device_id", "_day", measures, [7, 30], "feature_id")


_DAILY = """WITH once AS (SELECT DISTINCT ON (feature_id) feature_id, device_id, CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) AS day, {cols} FROM hourly_features),
    daily AS (SELECT device_id, day, {sums} FROM once GROUP BY ALL),
    ends AS (SELECT device_id, min(day) AS a, max(day) AS b FROM daily GROUP BY device_id),
    spine AS (SELECT device_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
    full_days AS (SELECT s.device_id, s.day, {fills} FROM spine s LEFT JOIN daily d ON d.device_id = s.device_id AND d.day = s.day)
    """
_GOOD = "CASE WHEN {c} >= 0 AND isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"


def _daily_sql(cols: list[str]) -> str:
    return _DAILY.format(
        cols=", ".join(cols),
        sums=", ".join(f"coalesce(sum({_GOOD.format(c=c)}), 0) AS s_{c}, count({_GOOD.format(c=c)}) AS c_{c}" for c in cols),
        fills=", ".join(f"coalesce(s_{c}, 0) AS s_{c}, coalesce(c_{c}, 0) AS c_{c}" for c in cols),
    )


def _over(x: str, p: int) -> str:
    return f"sum({x}) OVER (PARTITION BY device_id ORDER BY day ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


@add(
    "p7_found",
    _daily_sql(SUMS[:1])
    + f"SELECT device_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT device_id, day, {_over('s_' + SUMS[0], 7)} AS w, {_over('s_' + SUMS[0], 30)} AS m FROM full_days) WHERE w = 0 AND m > 0",
)
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _trailing(spark, folder, SUMS[:1]).where(F.col("device_id").isNotNull())
    quiet = (F.col(f"{SUMS[0]}_total_7") == 0) & (F.col(f"{SUMS[0]}_total_30") > 0)
    return rows.where(quiet).select("device_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _trailing_sql() -> str:
    out = []
    for c in SUMS:
        for p in (7, 30):
            s, n = _over(f"s_{c}", p), _over(f"c_{c}", p)
            out += [f"round({s}, 6) AS {c}_total_{p}", f"CAST({n} AS BIGINT) AS {c}_readings_{p}", f"round(CASE WHEN {n} > 0 THEN {s} / {n} END + 1e-9, 6) AS {c}_mean_{p}", f"round({s} / {p} + 1e-9, 6) AS {c}_day_mean_{p}"]
    return _daily_sql(SUMS) + f"SELECT device_id, day, {', '.join(out)} FROM full_days"


@add("p7_trailing", _trailing_sql())
def p7_trailing(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_trailing(spark, folder, SUMS))


@add("p7_corrected", _trailing_sql())
def p7_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The same from trees of the rows that were there on the next day, corrected by the ones that came later."""
    rows = once(table(spark, folder, "hourly_features").select("feature_id", "device_id", day().alias("_day"), "emitted_at", *SUMS), "feature_id")
    rows = written(rows.withColumn("_late", F.coalesce(F.datediff("emitted_at", "_day") > 1, F.lit(False))), "rows")
    part = lambda late: trailing.leaves(rows.where(F.col("_late") == late), "device_id", "_day", SUMS)
    forest = written(trailing.trees(part(False), "device_id", "_day", SUMS), "forest")
    return _shown(trailing.trailing(trailing.corrected(forest, part(True), "device_id", "_day", SUMS), "device_id", SUMS, [7, 30]))


def _shown(rows: DataFrame) -> DataFrame:
    # Rounded for the comparison with SQL; means are moved off the ties, which the order of summing would decide.
    shown = lambda c: F.round(c, 6) if "_total_" in c else F.round(F.col(c) + 1e-9, 6) if "mean_7" in c or "mean_30" in c else F.col(c)
    return rows.select(*[shown(c).alias(c) for c in rows.columns])


CANDIDATES = ["device_id", "app_id", "session_count", "_day", "_hour"]


def _fields() -> list[fill.Field]:
    """A value is missing if null or NaN, below zero in the times, not positive in app_id; a group's middle value takes times up to a day."""
    time = lambda c: F.coalesce(F.isnan(c) | (F.col(c) < 0), F.lit(True))
    groups = [("device_id",), ("app_id", "_hour"), ("app_id",), ()]
    return [
        fill.Field("app_id", F.coalesce(F.col("app_id") <= 0, F.lit(True)), [("_day", "_hour"), ()]),
        fill.Field("session_time", time("session_time"), groups, True, 0.0, 86400.0),
        fill.Field("expanding_mean_session_time", time("expanding_mean_session_time"), groups, True, 0.0, 86400.0),
    ]


def _filled(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "hourly_features").select("feature_id", "app_id", "device_id", "session_count", "session_time", "expanding_mean_session_time", day().alias("_day"), hour().alias("_hour"))
    return fill.filled(rows, _fields(), CANDIDATES, "feature_id")


@add(
    "p3_found",
    """SELECT DISTINCT feature_id, field FROM (SELECT feature_id, unnest([CASE WHEN app_id IS NULL OR app_id <= 0 THEN 'app_id' END,
    CASE WHEN session_time IS NULL OR isnan(session_time) OR session_time < 0 THEN 'session_time' END,
    CASE WHEN expanding_mean_session_time IS NULL OR isnan(expanding_mean_session_time) OR expanding_mean_session_time < 0 THEN 'expanding_mean_session_time' END]) AS field
    FROM hourly_features) WHERE field IS NOT NULL""",
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that a dictionary or a group has filled."""
    rows = _filled(spark, folder)
    marks = F.array(*[F.when(F.col(f"{f.name}_from") != "none", F.lit(f.name)) for f in _fields()])
    return rows.select("feature_id", F.explode(marks).alias("field")).where(F.col("field").isNotNull()).distinct()


def _filled_sql() -> str:
    """One dependency holds, device -> app; whether it does is counted here too. Middle values: the mean in the bin (an eighth of a power of two) of the median."""
    times = ["session_time", "expanding_mean_session_time"]
    bin_ = lambda c: f"CASE WHEN {c} = 0 THEN -99999 ELSE floor(log2({c}) * 8) END"
    middle = lambda keys: ", ".join(f"mid_{c} AS (SELECT {keys} v AS {c} FROM (SELECT *, s / n AS v, sum(n) OVER (PARTITION BY {keys} 1 ORDER BY b) AS upto, ceil(sum(n) OVER (PARTITION BY {keys} 1) / 2) AS half FROM (SELECT {keys} {bin_(c)} AS b, count(*) AS n, sum({c}) AS s FROM o WHERE {c} <= 86400 GROUP BY ALL)) WHERE upto >= half AND upto - n < half)" for c in times)
    by = lambda name, keys: f"{name} AS (WITH {middle(''.join(k + ', ' for k in keys))} SELECT * FROM mid_session_time FULL JOIN mid_expanding_mean_session_time " + (f"USING ({', '.join(keys)}))" if keys else "ON true)")
    out = ""
    for c in times:
        tries = [(f"d.{c}", "group:device_id"), (f"h.{c}", "group:app_id,_hour"), (f"a.{c}", "group:app_id"), (f"w.{c}", "all")]
        out += f", round(coalesce(f.{c}, {', '.join(t for t, _ in tries)}) + 1e-9, 6) AS {c}, CASE WHEN f.{c} IS NULL THEN CASE " + " ".join(f"WHEN {t} IS NOT NULL THEN '{n}'" for t, n in tries) + f" ELSE 'none' END END AS {c}_from"
    return f"""WITH r AS (SELECT feature_id, CASE WHEN app_id > 0 THEN app_id END AS app_id, device_id, session_count, {', '.join(f"CASE WHEN {c} >= 0 AND NOT isnan({c}) THEN {c} END AS {c}" for c in times)},
        TRY_CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) AS day, TRY_CAST(hour AS INT) AS hour FROM hourly_features),
    o AS (SELECT DISTINCT ON (feature_id) * FROM r),
    c AS (SELECT device_id, app_id, count(*) AS n FROM o WHERE device_id IS NOT NULL AND app_id IS NOT NULL GROUP BY ALL),
    v AS (SELECT device_id, count(*) AS many, max(n) AS top, sum(n) AS rows, any_value(app_id) AS app FROM c GROUP BY device_id),
    x AS (SELECT device_id, app FROM v WHERE many = 1 AND (SELECT sum(top) / sum(rows) FROM v) >= 0.99),
    m AS (SELECT day, hour, app_id AS app FROM (SELECT day, hour, app_id, count(*) AS n FROM o WHERE app_id IS NOT NULL GROUP BY ALL) WHERE day IS NOT NULL AND hour IS NOT NULL QUALIFY row_number() OVER (PARTITION BY day, hour ORDER BY n DESC, app_id DESC) = 1),
    u AS (SELECT app_id AS app FROM o WHERE app_id IS NOT NULL GROUP BY app_id ORDER BY count(*) DESC, app_id DESC LIMIT 1),
    f AS (SELECT r.* REPLACE (coalesce(r.app_id, x.app, m.app, u.app) AS app_id), CASE WHEN r.app_id IS NULL THEN CASE WHEN x.app IS NOT NULL THEN 'fd:device_id' WHEN m.app IS NOT NULL THEN 'group:_day,_hour' WHEN u.app IS NOT NULL THEN 'all' ELSE 'none' END END AS app_id_from
        FROM r LEFT JOIN x USING (device_id) LEFT JOIN m USING (day, hour) LEFT JOIN u ON true),
    {by("d", ["device_id"])}, {by("h", ["app_id", "hour"])}, {by("a", ["app_id"])}, {by("w", [])}
    SELECT f.feature_id, f.app_id, f.device_id, f.session_count, f.day, f.hour, f.app_id_from{out}
    FROM f LEFT JOIN d USING (device_id) LEFT JOIN h ON h.app_id = f.app_id AND h.hour = f.hour LEFT JOIN a ON a.app_id = f.app_id LEFT JOIN w ON true"""


@add("p3_filled", _filled_sql())
def p3_filled(spark: SparkSession, folder: str) -> DataFrame:
    shown = {c: F.round(F.col(c) + 1e-9, 6) for c in ("session_time", "expanding_mean_session_time")}
    return _filled(spark, folder).withColumns(shown).withColumnsRenamed({"_day": "day", "_hour": "hour"})
