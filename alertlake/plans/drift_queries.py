"""Registered queries of monitoring and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import drift as M
from alertlake.plans.catalog import query
from alertlake.plans.views import AS_OF, METRIC_LOGS, metric_logs, table

NOW = f"TIMESTAMP '{AS_OF}'"
RECENT = f"timestamp >= {NOW} - INTERVAL 7 DAY"
BASE = f"timestamp >= {NOW} - INTERVAL 30 DAY AND timestamp < {NOW} - INTERVAL 7 DAY"


@query("mon_perf_recent", f"SELECT timestamp, query_id, query_type, response_time_seconds FROM {METRIC_LOGS} WHERE {RECENT}")
def mon_perf_recent(spark, folder):
    return M.recent(metric_logs(spark, folder), AS_OF).select("timestamp", "query_id", "query_type", "response_time_seconds")


@query("mon_usage_recent", f"SELECT timestamp, query_id, tokens_prompt, tokens_completion FROM {METRIC_LOGS} WHERE {RECENT}")
def mon_usage_recent(spark, folder):
    return M.recent(metric_logs(spark, folder), AS_OF).select("timestamp", "query_id", "tokens_prompt", "tokens_completion")


def drift_sql(value, rule, threshold):
    return f"""
    SELECT '{value}' AS metric, {rule} AS drift_detected, CAST(NULL AS VARCHAR) AS reason, round(b, 6) AS baseline_value,
           round(c, 6) AS current_value, round((c - b) / b * 100, 6) AS percent_change, CAST({threshold} AS DOUBLE) AS threshold
    FROM (SELECT AVG({value}) FILTER (WHERE {BASE}) AS b, AVG({value}) FILTER (WHERE {RECENT}) AS c FROM {METRIC_LOGS})"""


TIME_SQL = drift_sql("response_time_seconds", "abs((c - b) / b * 100) > 20", 20)
QUALITY_SQL = drift_sql("alert_quality", "(c - b) / b * 100 < -15", -15)
MEANS = """(
    SELECT late, list(m ORDER BY i) AS m FROM (SELECT late, i, AVG(v) AS m FROM (
        SELECT label >= 5 AS late, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY 1, 2) GROUP BY 1)"""
VECTOR_SQL = f"""
    SELECT 'embedding_cosine_distance' AS metric, d > 0.1 AS drift_detected, round(d, 5) AS distance, CAST(0.1 AS DOUBLE) AS threshold
    FROM (SELECT list_cosine_distance(a.m, b.m) AS d FROM {MEANS} a, {MEANS} b WHERE NOT a.late AND b.late)"""


def rounded(df):
    digits = {"baseline_value": 6, "current_value": 6, "percent_change": 6, "distance": 5}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


@query("drift_response_time", TIME_SQL)
def drift_response_time(spark, folder):
    return rounded(M.response_time_drift(metric_logs(spark, folder), AS_OF))


@query("drift_feedback", QUALITY_SQL)
def drift_feedback(spark, folder):
    return rounded(M.feedback_drift(metric_logs(spark, folder), AS_OF))


def two_sides(spark, folder):
    """All vectors, split by label into an earlier and a later table."""
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    return vectors.where(F.col("label") < 5), vectors.where(F.col("label") >= 5)


@query("drift_embedding", VECTOR_SQL)
def drift_embedding(spark, folder):
    return rounded(M.embedding_drift(*two_sides(spark, folder))).drop("reason")


@query("trend_daily_avg", f"""
    SELECT CAST(timestamp AS DATE) AS date, round(AVG(response_time_seconds), 9) AS average_response_time_seconds FROM {METRIC_LOGS} GROUP BY 1""")
def trend_daily_avg(spark, folder):
    days = M.daily_average(metric_logs(spark, folder), "response_time_seconds")
    return days.withColumn("average_response_time_seconds", F.round("average_response_time_seconds", 9))


@query("emb_pca2", """
    SELECT CASE WHEN label < 5 THEN 'baseline' ELSE 'current' END AS side, COUNT(*) AS vectors, TRUE AS centred, TRUE AS shares_hold
    FROM embeddings GROUP BY 1""")
def emb_pca2(spark, folder):
    """All vectors of both tables on their two main axes: how many there are, that the axes stand apart, and that an axis's share is
    its variance by the total variance."""
    sides = two_sides(spark, folder)
    points = M.plane(*sides)
    values = sides[0].unionByName(sides[1]).select(F.posexplode("embedding").alias("i", "v"))
    spread = values.groupBy("i").agg(F.var_samp("v").alias("s")).agg(F.sum("s")).scalar()
    whole = points.agg(F.struct(F.var_samp("x").alias("x"), F.var_samp("y").alias("y"), F.covar_samp("x", "y").alias("xy"))).scalar()
    per_side = points.groupBy("side").agg(F.count(F.lit(1)).alias("vectors"), F.max("x_share").alias("x_share"), F.max("y_share").alias("y_share"))
    near = lambda a, b: F.abs(a - b) < 1e-6
    return per_side.select("side", "vectors", near(whole["xy"], F.lit(0.0)).alias("centred"),
                           (near(F.col("x_share"), whole["x"] / spread) & near(F.col("y_share"), whole["y"] / spread)).alias("shares_hold"))


@query("drift_all", f"""
    SELECT metric, drift_detected, percent_change, distance, threshold, bool_or(drift_detected) OVER () AS any_drift_detected FROM (
        SELECT metric, drift_detected, percent_change, CAST(NULL AS DOUBLE) AS distance, threshold FROM ({TIME_SQL})
        UNION ALL SELECT metric, drift_detected, percent_change, NULL, threshold FROM ({QUALITY_SQL})
        UNION ALL SELECT metric, drift_detected, NULL, distance, threshold FROM ({VECTOR_SQL}))""")
def drift_all(spark, folder):
    logs = metric_logs(spark, folder)
    checks = rounded(M.all_checks(logs, logs, *two_sides(spark, folder), AS_OF))
    return checks.select("metric", "drift_detected", "percent_change", "distance", "threshold", "any_drift_detected")
