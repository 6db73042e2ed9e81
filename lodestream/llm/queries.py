"""Queries p1, p4, p5, p8, p9 and p10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.clean import day, once
from lodestream.functions.text import token_count
from lodestream.llm import cutoffs, mixing, packing, quantiles, ranking, spans
from lodestream.operators.ordered import small
from lodestream.plans.registry import Registry, table
from lodestream.scratch import written

REGISTRY = Registry()
add = REGISTRY.add

_P1 = """WITH once AS (SELECT DISTINCT score_id, app_id, Severity_final FROM severity_scores WHERE app_id IS NOT NULL AND isfinite(Severity_final)),
    counts AS (SELECT app_id, Severity_final AS score, count(*) AS n FROM once GROUP BY ALL),
    runs AS (SELECT app_id, score, sum(n) OVER (PARTITION BY app_id ORDER BY score DESC) AS upto, sum(n) OVER (PARTITION BY app_id) AS total FROM counts),
    cuts AS (SELECT app_id, any_value(target_fraction) AS target_fraction, max(CASE WHEN upto / total >= target_fraction THEN score END) AS cutoff,
        min(CASE WHEN upto / total >= target_fraction THEN upto END) AS kept, max(total) AS total FROM runs JOIN keep_targets USING (app_id) GROUP BY app_id)
    """


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return written(once(table(spark, folder, "severity_scores").select("score_id", "app_id", "Severity_final"), "score_id"), "scores")


@add("p1_found", _P1 + "SELECT score_id FROM once JOIN cuts USING (app_id) WHERE Severity_final >= cutoff")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scores(spark, folder)
    cuts = written(cutoffs.cutoffs(rows, table(spark, folder, "keep_targets"), "app_id", "Severity_final", "target_fraction"), "cuts")
    return cutoffs.kept(rows, cuts, "app_id", "Severity_final").select("score_id")


@add(
    "p1_cutoffs",
    _P1 + """SELECT app_id, k.target_fraction, cutoff, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(total, 0) AS BIGINT) AS total, kept / total AS share
    FROM cuts c RIGHT JOIN keep_targets k USING (app_id)""",
)
def p1_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return cutoffs.cutoffs(_scores(spark, folder), table(spark, folder, "keep_targets"), "app_id", "Severity_final", "target_fraction")


POINTS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: Rank error of the day summaries as a share of the rows.
ERROR = 0.005


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    """``field, app_id, day, value``: each feature once, without values that are missing or below zero."""
    rows = table(spark, folder, "hourly_features").select("feature_id", "app_id", day().alias("day"), "session_time", "session_count")
    rows = once(rows, "feature_id").withColumn("session_time", F.when(F.col("session_time") >= 0, F.col("session_time")))
    rows = rows.withColumn("session_count", F.when(F.col("session_count") >= 0, F.col("session_count")))
    return quantiles.melted(rows, ["app_id", "day"], ["session_time", "session_count"])


@add(
    "p4_percentiles",
    """WITH once AS (SELECT DISTINCT ON (feature_id) app_id, CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) AS day, session_time, session_count FROM hourly_features),
    long AS (SELECT 'session_time' AS field, app_id, day, session_time AS value FROM once WHERE session_time >= 0 AND isfinite(session_time)
        UNION ALL SELECT 'session_count', app_id, day, session_count FROM once WHERE session_count >= 0)
    SELECT field, app_id, day, count(*) AS readings, """
    + ", ".join(f"round(quantile_cont(CAST(value AS DOUBLE), {q}) + 1e-9, 5) AS {n}" for n, q in POINTS.items())
    + " FROM long GROUP BY ALL",
)
def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    out = quantiles.quantiles(_readings(spark, folder), ["field", "app_id", "day"], "value", POINTS)
    return out.select("field", "app_id", "day", "readings", *[F.round(F.col(n) + 1e-9, 5).alias(n) for n in POINTS])


#: Each day's values with running counts; the kept ones, with the rows they stand for.
_DAYS = f"""WITH once AS (SELECT DISTINCT ON (feature_id) app_id, CAST(replace(substr(trim(date), 1, 10), '/', '-') AS DATE) AS day, session_time, session_count FROM hourly_features),
    long AS (SELECT 'session_time' AS field, app_id, day, session_time AS value FROM once WHERE session_time >= 0 AND isfinite(session_time)
        UNION ALL SELECT 'session_count', app_id, day, session_count FROM once WHERE session_count >= 0),
    c AS (SELECT field, app_id, day, value, count(*) AS n FROM long GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY field, app_id, day ORDER BY value) AS upto, sum(n) OVER (PARTITION BY field, app_id, day) AS total FROM c),
    k AS (SELECT *, greatest(1, floor(total * {ERROR})) AS step FROM r),
    days AS (SELECT field, app_id, day, value, CAST(CASE WHEN upto = total THEN total ELSE floor(upto / step) * step END - floor((upto - n) / step) * step AS BIGINT) AS weight FROM k
        WHERE floor(upto / step) > floor((upto - n) / step) OR upto = total)"""


@add("p4_summaries", _DAYS + " SELECT * FROM days")
def p4_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """What is kept of each app's day, to be put together with other days or files."""
    return quantiles.summary(_readings(spark, folder), ["field", "app_id", "day"], "value", ERROR)


@add(
    "p4_merged",
    _DAYS + """, w AS (SELECT field, app_id, value, sum(weight) AS n FROM days GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY field, app_id ORDER BY value) AS upto, sum(n) OVER (PARTITION BY field, app_id) AS total FROM w)
    SELECT field, app_id, CAST(max(total) AS BIGINT) AS readings, """
    + ", ".join(f"min(CASE WHEN upto >= ceil(total * CAST({q} AS DOUBLE)) THEN value END) AS {n}" for n, q in POINTS.items())
    + f", CAST(ceil(max(total) * CAST({ERROR} AS DOUBLE)) AS BIGINT) AS rank_error FROM u GROUP BY field, app_id",
)
def p4_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per app over all days, from the summaries of its days, with the rank error that holds."""
    days = quantiles.summary(_readings(spark, folder), ["field", "app_id", "day"], "value", ERROR)
    out = quantiles.merged_quantiles(days, ["field", "app_id"], POINTS)
    return out.withColumn("rank_error", F.ceil(F.col("readings") * ERROR))


@add(
    "p4_merged_ranks",
    """WITH once AS (SELECT DISTINCT ON (feature_id) app_id, session_time, session_count FROM hourly_features),
    long AS (SELECT 'session_time' AS field, app_id, session_time AS value FROM once WHERE session_time >= 0 AND isfinite(session_time) UNION ALL SELECT 'session_count', app_id, session_count FROM once WHERE session_count >= 0)
    SELECT field, app_id, count(*) AS readings, """
    + ", ".join(f"true AS {n}" for n in POINTS)
    + " FROM long GROUP BY ALL",
)
def p4_merged_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each merged percentile has a rank within the stated error, counted over all readings."""
    rows = written(_readings(spark, folder), "readings")
    merged = quantiles.merged_quantiles(quantiles.summary(rows, ["field", "app_id", "day"], "value", ERROR), ["field", "app_id"], POINTS)
    merged = small(written(merged.withColumnsRenamed({"field": "_f", "app_id": "_a", "readings": "_n"}), "merged"))
    both = rows.join(merged, (F.col("field") == F.col("_f")) & F.col("app_id").eqNullSafe(F.col("_a")))
    sides = [x for n in POINTS for x in (F.count(F.when(F.col("value") < F.col(n), 1)).alias(f"{n}_lo"), F.count(F.when(F.col("value") <= F.col(n), 1)).alias(f"{n}_hi"))]
    ranks = both.groupBy("field", "app_id").agg(F.count("*").alias("readings"), F.max("_n").alias("_n"), *sides)
    off = F.col("readings") * ERROR
    within = [((F.col(f"{n}_lo") < F.ceil(F.col("readings") * q) + off) & (F.col(f"{n}_hi") > F.ceil(F.col("readings") * q) - off) & (F.col("_n") == F.col("readings"))).alias(n) for n, q in POINTS.items()]
    return ranks.select("field", "app_id", "readings", *within)


SCORES = ["SC_z_score_session_cnt", "SS_z_score_max", "ZB_z_score", "Severity_final"]


def _ranking(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(once(table(spark, folder, "severity_scores").select("score_id", *SCORES), "score_id"), "scores")
    return ranking.ranking(rows, "score_id", SCORES)


@add(
    "p5_found",
    "WITH once AS (SELECT DISTINCT ON (score_id) * FROM severity_scores), limits AS (SELECT "
    + ", ".join(f"quantile_cont(CASE WHEN isfinite({c}) THEN {c} END, 0.98) AS q{i}" for i, c in enumerate(SCORES))
    + " FROM once) SELECT score_id FROM once, limits WHERE "
    + " AND ".join(f"isfinite({c}) AND {c} >= q{i}" for i, c in enumerate(SCORES)),
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that stand at the ideal point: with winsor limits at 2 and 98 percent they lead the ranking, all with closeness 1."""
    return _ranking(spark, folder).where((F.col("to_ideal") == 0) & (F.col("missing") == 0)).select("score_id")


def _closeness_sql() -> str:
    fin = {c: f"CASE WHEN isfinite({c}) THEN {c} END" for c in SCORES}
    limits = ", ".join(f"quantile_cont({x}, 0.02) AS lo{i}, quantile_cont({x}, 0.5) AS mid{i}, quantile_cont({x}, 0.98) AS hi{i}" for i, x in enumerate(fin.values()))
    clipped = ", ".join(f"least(greatest(coalesce({x}, mid{i}), lo{i}), hi{i}) AS y{i}, lo{i}, hi{i}" for i, x in enumerate(fin.values()))
    norms = ", ".join(f"sqrt(sum(y{i} * y{i})) AS n{i}" for i in range(4))
    up, down = (" + ".join(f"pow({side} / n{i}, 2)" for i, side in enumerate(sides)) for sides in ([f"(hi{i} - y{i})" for i in range(4)], [f"(y{i} - lo{i})" for i in range(4)]))
    return f"""WITH once AS (SELECT DISTINCT ON (score_id) * FROM severity_scores), limits AS (SELECT {limits} FROM once), c AS (SELECT score_id, {clipped} FROM once, limits), n AS (SELECT {norms} FROM c)
    SELECT score_id, round(sqrt({down}) / (sqrt({up}) + sqrt({down})) + 1e-9, 6) AS closeness FROM c, n"""


@add("p5_closeness", _closeness_sql())
def p5_closeness(spark: SparkSession, folder: str) -> DataFrame:
    rows = written(once(table(spark, folder, "severity_scores").select("score_id", *SCORES), "score_id"), "scores")
    return ranking.closeness(rows, SCORES).select("score_id", F.round(F.col("closeness") + 1e-9, 6).alias("closeness"))


@add("p5_ranking")
def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _ranking(spark, folder)


#: The project's tokens in DuckDB's regular expressions.
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]'))"
_CAPACITY = "(SELECT limit_value FROM text_limits WHERE limit_name = 'capacity_tokens')"


def _limit(spark: SparkSession, folder: str, name: str) -> int:
    return table(spark, folder, "text_limits").where(F.col("limit_name") == name).first()["limit_value"]


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = written(table(spark, folder, "documents").select("doc_id", token_count(F.col("text")).alias("tokens")), "sizes")
    return packing.packed(sizes, "doc_id", "tokens", _limit(spark, folder, "capacity_tokens"))


@add("p8_found", f"SELECT doc_id FROM documents WHERE {_TOKENS} > {_CAPACITY}")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing had to split: they lie in more than one container."""
    where = _packed(spark, folder).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return where.where("a < b").select("doc_id")


@add("p8_packing")
def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


@add("p8_containers")
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(_packed(spark, folder), _limit(spark, folder, "capacity_tokens"))


@add(
    "p8_pieces",
    f"""WITH sizes AS (SELECT doc_id, coalesce({_TOKENS}, 0) AS n, {_CAPACITY} AS c FROM documents), parts AS (SELECT doc_id, n, c, greatest(1, CAST(ceil(n / c) AS INT)) AS pieces FROM sizes)
    SELECT doc_id, CAST(piece AS INT) AS piece, CAST(pieces AS INT) AS pieces, CAST(CASE WHEN piece < pieces THEN c ELSE n - (pieces - 1) * c END AS INT) AS size, true AS fits FROM (SELECT *, unnest(range(1, pieces + 1)) AS piece FROM parts)""",
)
def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece once, and whether its container holds no more than its capacity."""
    items = written(_packed(spark, folder), "items")
    capacity = _limit(spark, folder, "capacity_tokens")
    over = packing.containers(items, capacity).where("unused < 0").select("container", F.lit(False).alias("_fits"))
    return items.join(over, "container", "left").select("doc_id", "piece", "pieces", "size", F.coalesce("_fits", F.lit(True)).alias("fits"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = table(spark, folder, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens"))
    return mixing.mixed(sizes, table(spark, folder, "source_weights"), "doc_id", "source", "tokens")


@add(
    "p9_found",
    f"""WITH own AS (SELECT nullif(lower(trim(source)), '') AS source, sum({_TOKENS}) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT source FROM source_weights LEFT JOIN own USING (source) WHERE coalesce(tokens, 0) * max_repeats < target_weight * (SELECT sum(tokens) FROM own)""",
)
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that are in the mixture as often as they may and still short of their share of all tokens."""
    short = (F.col("size") == F.col("own") * F.col("max_repeats")) & (F.col("size") < F.col("target_weight") * F.col("total"))
    return _mixed(spark, folder)[1].where(short).select("source")


@add("p9_mixture")
def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0]


@add(
    "p9_within",
    f"""WITH own AS (SELECT nullif(lower(trim(source)), '') AS source, sum({_TOKENS}) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY 1)
    SELECT source, coalesce(tokens, 0) * max_repeats >= target_weight * (SELECT sum(tokens) FROM own) AS reachable, true AS within FROM source_weights LEFT JOIN own USING (source)""",
)
def p9_within(spark: SparkSession, folder: str) -> DataFrame:
    """Reachable sources are within the tolerance of their target share of the mixture, the others are used as often as they may."""
    report = _mixed(spark, folder)[1]
    near = F.abs(F.col("actual_share") - F.col("target_share")) <= F.col("tolerance")
    return report.select("source", "reachable", F.when(F.col("reachable"), near).otherwise(F.col("size") == F.col("own") * F.col("max_repeats")).alias("within"))


@add("p9_shares")
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


@add(
    "p10_found",
    """WITH span AS (SELECT limit_value AS n FROM text_limits WHERE limit_name = 'min_span_chars'),
    grams AS (SELECT DISTINCT doc_id, md5(substr(text, i, n)) AS h FROM (SELECT doc_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM documents, span WHERE length(text) >= n)),
    common AS (SELECT h FROM grams GROUP BY h HAVING count(*) > 1), g AS (SELECT * FROM grams SEMI JOIN common USING (h))
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
)
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pairs = spans.shared_pairs(docs, "doc_id", "text", _limit(spark, folder, "min_span_chars"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


@add(
    "p10_shared",
    """WITH span AS (SELECT limit_value AS n FROM text_limits WHERE limit_name = 'min_span_chars'),
    grams AS (SELECT doc_id, i, n, md5(substr(text, i, n)) AS h FROM (SELECT doc_id, text, n, unnest(range(1, length(text) - n + 2)) AS i FROM documents, span WHERE length(text) >= n)),
    common AS (SELECT h FROM grams GROUP BY h HAVING count(DISTINCT doc_id) > 1),
    steps AS (SELECT doc_id, n, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS step FROM grams SEMI JOIN common USING (h)),
    covered AS (SELECT doc_id, sum(least(coalesce(step, n), n)) AS chars, count(CASE WHEN coalesce(step, n + 1) > n THEN 1 END) AS spans FROM steps GROUP BY doc_id),
    whole AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '-' || doc_id)) AS class, count(*) OVER (PARTITION BY coalesce(text, '-' || doc_id)) AS copies, coalesce(length(text), 0) AS n_chars FROM documents)
    SELECT doc_id, class, copies, CAST(n_chars AS INT) AS n_chars, coalesce(spans, 0) AS spans, CAST(coalesce(chars, 0) AS BIGINT) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(chars, 0) / n_chars ELSE 0.0 END AS shared FROM whole LEFT JOIN covered USING (doc_id)""",
)
def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spans.shared_parts(docs, "doc_id", "text", _limit(spark, folder, "min_span_chars"))


@add("p10_members")
def p10_members(spark: SparkSession, folder: str) -> DataFrame:
    """Which classes of equal texts have which spans: a row per member, not per pair."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spans.span_members(docs, "doc_id", "text", _limit(spark, folder, "min_span_chars"))
