"""Registered queries of alert assembly and consumption."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.plans.catalog import query
from alertlake.plans.detector_queries import FRAUD_SQL, GAPS, LARGE_SQL, LOGIN_SQL, NIGHT_SQL, PLACES_SQL, TOP3, VELOCITY_SQL
from alertlake.plans.trend_queries import RULE_ROWS, standing
from alertlake.plans.views import ORDER_SUMMARIES, RUN_ID, TXN_EVENTS, order_summaries, table, txn_events

ANOMALIES = "(" + " UNION ALL ".join([LARGE_SQL.format(q=0.95), FRAUD_SQL, LOGIN_SQL, NIGHT_SQL, VELOCITY_SQL, PLACES_SQL]) + ")"
RANK = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 99 END"
STAMP = "TIMESTAMP '2024-01-31 00:00:00'"


def numbered(low: bool) -> str:
    return f"""(
    SELECT 'alert_' || ROW_NUMBER() OVER (ORDER BY {RANK}, type) || '_{RUN_ID}' AS id, '{RUN_ID}' AS run_id, type, severity,
           'new' AS status, {STAMP} AS timestamp, 'Alert: ' || type AS title,
           'Anomaly detected of type ' || type || ' with severity ' || severity AS description,
           'Review the anomaly details|Investigate transactions' AS actions, count
    FROM {ANOMALIES} {'' if low else "WHERE severity <> 'low'"})"""


BEHIND = f"""(
    SELECT TransactionID, Location, anomaly_type FROM {RULE_ROWS}
    UNION ALL SELECT TransactionID, Location, 'velocity_anomaly' FROM {GAPS} WHERE gap < 5
    UNION ALL SELECT TransactionID, Location, 'location_insights' FROM {TXN_EVENTS} WHERE Location IN (SELECT Location FROM {TOP3}))"""


def found(spark, folder):
    return D.detect_upload(txn_events(spark, folder))


def alerts(spark, folder, threshold=0.7):
    return A.basic_alerts(found(spark, folder), RUN_ID, threshold)


def flat(df, *more):
    return df.select("id", "run_id", "type", "severity", "status", "timestamp", "title", "description",
                     F.array_join("recommended_actions", "|").alias("actions"), F.col("anomaly.count").alias("count"), *more)


@query("alerts_gated", f"SELECT type, severity, count FROM {ANOMALIES} WHERE severity <> 'low'")
def alerts_gated(spark, folder):
    return A.gate(found(spark, folder)).select("type", "severity", "count")


@query("alerts_basic", f"""
    SELECT n.*, (SELECT string_agg(TransactionID, ',' ORDER BY TransactionID) FROM (SELECT TransactionID FROM {BEHIND} b WHERE b.anomaly_type = n.type
                 ORDER BY TransactionID LIMIT 5)) AS related_ids,
           (SELECT ' at ' || string_agg(DISTINCT Location, ', ' ORDER BY Location) FROM {BEHIND} p WHERE p.anomaly_type = n.type) AS location_info
    FROM {numbered(False)} n""")
def alerts_basic(spark, folder):
    """Alert records with the first rows behind each and their places."""
    df = txn_events(spark, folder)
    records = A.basic_alerts(D.detect_upload(df), RUN_ID, 0.7, A.related_rows(df))
    ids = F.array_join(F.transform("related", lambda r: r["TransactionID"]), ",")
    return flat(records, ids.alias("related_ids"), "location_info")


@query("custom_detector", f"""
    SELECT 'large_at_night' AS type, 'high' AS severity, COUNT(*) AS count FROM {TXN_EVENTS} WHERE hour(TransactionDate) < 5 AND TransactionAmount > 50""")
def custom_detector(spark, folder):
    """A detector of one's own among the others."""
    def large_at_night(df):
        found = df.where((F.hour("TransactionDate") < 5) & (F.col("TransactionAmount") > 50)).agg(F.count(F.lit(1)).alias("count"))
        return found.select(F.lit("large_at_night").alias("type"), F.lit("high").alias("severity"), "count")

    D.register_detector("large_at_night", large_at_night)
    try:
        return found(spark, folder).where(F.col("type") == "large_at_night").select("type", "severity", "count")
    finally:
        D.unregister_detector("large_at_night")


UPLOAD_QUERY = """CASE type
        WHEN 'large_transactions' THEN 'Generate an alert for ' || count || ' unusually large transactions above ' || printf('%.2f', threshold)
        WHEN 'fraud_flags' THEN 'Generate an alert for ' || count || ' transactions flagged as potential fraud'
        WHEN 'high_login_attempts' THEN 'Generate an alert for ' || count || ' transactions with high login attempts above 5'
        WHEN 'overnight_transactions' THEN 'Generate an alert for ' || count || ' transactions occurring during overnight hours (12am-5am)'
        WHEN 'velocity_anomaly' THEN 'Generate an alert for ' || count || ' transactions occurring in rapid succession'
        ELSE 'Generate an alert for ' || type || ' with severity ' || severity END"""


@query("anomaly_query_text", f"""
    WITH s AS {ORDER_SUMMARIES},
         g AS (SELECT Location, AVG(TransactionCount) AS m, COALESCE(STDDEV_SAMP(TransactionCount), 1) AS d FROM s GROUP BY 1),
         o AS (SELECT s.*, m, ROW_NUMBER() OVER (PARTITION BY s.Location ORDER BY Date) AS r
               FROM s JOIN g USING (Location) WHERE abs(TransactionCount - m) > 2 * d)
    SELECT type, CAST(NULL AS VARCHAR) AS entity, {UPLOAD_QUERY} AS query FROM {ANOMALIES}
    UNION ALL
    SELECT 'high_large_transaction_ratio', NULL, 'Generate an alert for ' || COUNT(*) || ' branches with unusually high ratio of large transactions'
    FROM s WHERE LargeTransactionCount / TransactionCount > 0.15
    UNION ALL
    SELECT 'unusual_transaction_volume', Location, 'Generate an alert for branch ' || Location || ' with unusual transaction volume of '
           || TransactionCount || ' vs expected ' || CAST(trunc(m) AS BIGINT) FROM o WHERE r = 1
    UNION ALL
    SELECT 'events_' || c || '_extreme_' || side, NULL, 'Generate an alert for unusually ' || side || ' values in events_' || c
    FROM (VALUES ('LoginAttempts'), ('TransactionAmount'), ('AccountBalance')) v(c), (VALUES ('high'), ('low')) w(side)""")
def anomaly_query_text(spark, folder):
    """Query texts of every kind of anomaly the detectors can give."""
    days = order_summaries(spark, folder)
    fences = D.extreme_fences(txn_events(spark, folder).select("LoginAttempts", "TransactionAmount", "AccountBalance"), "events")
    everything = D.union_all([found(spark, folder), D.high_large_ratio(days), D.unusual_volume(days), D.to_anomaly(fences.drop("fired"))])
    return everything.select("type", "entity", A.anomaly_query().alias("query"))


@query("anomaly_json", f"""
    SELECT type, {UPLOAD_QUERY} AS query, severity, CAST(count AS VARCHAR) AS count, round(threshold, 6) AS threshold, details FROM {ANOMALIES}""")
def anomaly_json(spark, folder):
    """Queries with JSON context, taken apart again."""
    parts = F.split("augmented_query", "\n\nContext: ", 2)
    context = {c: F.get_json_object(parts[1], f"$.{c}") for c in ("severity", "count", "threshold", "details")}
    return A.anomaly_json(found(spark, folder)).select(
        "type", parts[0].alias("query"), context["severity"].alias("severity"), context["count"].alias("count"),
        F.round(context["threshold"].cast("double"), 6).alias("threshold"), context["details"].alias("details"))


@query("alert_related", f"""
    SELECT anomaly_type, string_agg(TransactionID, ',' ORDER BY TransactionID) FILTER (WHERE r <= 5) AS related_ids,
           (SELECT ' at ' || string_agg(DISTINCT Location, ', ' ORDER BY Location) FROM {BEHIND} p WHERE p.anomaly_type = t.anomaly_type)
             AS location_info
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anomaly_type ORDER BY TransactionID) AS r FROM {BEHIND}) t GROUP BY 1""")
def alert_related(spark, folder):
    """First rows and places of every anomaly, those of rapid succession and of top locations included."""
    rows = A.related_rows(txn_events(spark, folder))
    return rows.select("anomaly_type", F.array_join(F.transform("related", lambda r: r["TransactionID"]), ",").alias("related_ids"),
                       "location_info")


@query("alerts_filter", f"SELECT * FROM {numbered(True)} WHERE severity IN ('high', 'low')")
def alerts_filter(spark, folder):
    return flat(A.by_severity(alerts(spark, folder, 0.5), ["high", "low"]))


@query("alerts_ranked", f"""
    SELECT id, type, severity, {RANK} AS severity_rank, ROW_NUMBER() OVER (ORDER BY {RANK}, id) AS position FROM {numbered(True)}""")
def alerts_ranked(spark, folder):
    """Most severe first; the position is where a record stands in the sorted table."""
    return standing(A.ranked(alerts(spark, folder, 0.5)).select("id", "type", "severity", "severity_rank"))


@query("alerts_headline", f"""
    SELECT 'fraud' AS headline, id, type FROM (SELECT * FROM {numbered(True)} WHERE type IN ('fraud_flags', 'high_login_attempts', 'velocity_anomaly')
           ORDER BY {RANK}, id LIMIT 1)
    UNION ALL
    SELECT 'general', id, type FROM (SELECT * FROM {numbered(True)} WHERE type NOT IN ('fraud_flags', 'high_login_attempts') ORDER BY {RANK}, id LIMIT 1)""")
def alerts_headline(spark, folder):
    return A.headlines(alerts(spark, folder, 0.5)).select("headline", "id", "type")


@query("alerts_custom", """
    SELECT 'custom_20240131000000_' || substr(sha256(text), 1, 16) AS id, 'custom_query' AS type, 'medium' AS severity, 'new' AS status,
           'Custom Alert' AS title, 'No description available' AS description, text AS query FROM benchmark""")
def alerts_custom(spark, folder):
    """Every benchmark text as an ad hoc question."""
    requests = table(spark, folder, "benchmark").select(F.col("text").alias("query"))
    return A.custom_alerts(requests, RUN_ID).select("id", "type", "severity", "status", "title", "description", "query")


@query("parse_responses", r"""
    SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE
               substring(COALESCE(list_filter(string_split(trim(text), chr(10)), lambda x: regexp_matches(x, '\S'))[1], 'Alert Generated'), 1, 100) END AS title,
           text AS description,
           CASE WHEN lang = 'en' THEN lang ELSE
               'Review the alert details|Investigate related transactions|Consider updating monitoring rules' END AS actions
    FROM documents""")
def parse_responses(spark, folder):
    """Replies made of documents: English ones as JSON objects, the others as bare text."""
    as_json = F.to_json(F.struct(F.col("source").alias("title"), F.col("text").alias("description"),
                                 F.array("lang").alias("recommended_actions")))
    replies = table(spark, folder, "documents").select(
        "doc_id", F.when(F.col("lang") == "en", as_json).otherwise(F.col("text")).alias("response"))
    return A.parse_responses(replies).select("doc_id", "title", "description", F.array_join("recommended_actions", "|").alias("actions"))
