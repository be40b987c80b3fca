"""Registered queries of the anomaly detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import detectors as D
from alertlake.plans.catalog import query
from alertlake.plans.views import ORDER_SUMMARIES, TXN_EVENTS, order_summaries, txn_events

SHORT = ["type", "severity", "count", "threshold", "details"]

LARGE_SQL = """
    SELECT 'large_transactions' AS type, 'medium' AS severity, COUNT(*) AS count, round(MAX(q), 6) AS threshold,
           'Found ' || COUNT(*) || ' transactions above ' || printf('%.2f', MAX(q)) AS details
    FROM events, (SELECT quantile_cont(value, {q}) AS q FROM events) WHERE value > q"""
FRAUD_SQL = """
    SELECT 'fraud_flags' AS type, 'high' AS severity, COUNT(*) AS count, CAST(NULL AS DOUBLE) AS threshold,
           'Found ' || COUNT(*) || ' transactions flagged as fraudulent' AS details
    FROM events WHERE event_type = 'error'"""
LOGIN_SQL = f"""
    SELECT 'high_login_attempts' AS type, 'medium' AS severity, COUNT(*) AS count, CAST(5 AS DOUBLE) AS threshold,
           'Found ' || COUNT(*) || ' transactions with login attempts > 5' AS details
    FROM {TXN_EVENTS} WHERE LoginAttempts > 5"""
NIGHT_SQL = """
    SELECT 'overnight_transactions' AS type, 'medium' AS severity, COUNT(*) AS count, CAST(NULL AS DOUBLE) AS threshold,
           'Found ' || COUNT(*) || ' transactions during overnight hours (12am-5am)' AS details
    FROM events WHERE hour(ts) < 5"""
GAPS = f"""(
    SELECT *, date_diff('microsecond', LAG(TransactionDate) OVER (PARTITION BY CustomerID ORDER BY TransactionDate, TransactionID),
                        TransactionDate) / 6e7 AS gap FROM {TXN_EVENTS})"""
VELOCITY_SQL = f"""
    SELECT 'velocity_anomaly' AS type, 'high' AS severity, COUNT(*) AS count, CAST(NULL AS DOUBLE) AS threshold,
           'Found ' || COUNT(*) || ' transactions occurring in rapid succession (<5 min apart)' AS details
    FROM {GAPS} WHERE gap < 5"""
TOP3 = f"(SELECT Location, COUNT(*) AS n FROM {TXN_EVENTS} GROUP BY 1 ORDER BY n DESC, Location LIMIT 3)"
PLACES_SQL = f"""
    SELECT 'location_insights' AS type, 'low' AS severity, CAST(SUM(n) AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS threshold,
           'Top transaction locations: ' || string_agg(Location, ', ' ORDER BY n DESC, Location) AS details
    FROM {TOP3}"""


def short(df):
    return df.select(*SHORT).withColumn("threshold", F.round("threshold", 6))


def one_rule(name, limits=D.UPLOAD):
    def build(spark, folder):
        df = txn_events(spark, folder)
        return short(D.count_rules(df, D.row_rules(df, limits, [name])))
    return build


query("det_large_q95", LARGE_SQL.format(q=0.95))(one_rule("large_transactions"))
query("det_fraud_flags", FRAUD_SQL)(one_rule("fraud_flags"))
query("det_high_logins", LOGIN_SQL)(one_rule("high_login_attempts"))
query("det_overnight", NIGHT_SQL)(one_rule("overnight_transactions"))


@query("det_large_q99", """
    WITH hit AS (SELECT CAST(event_id AS VARCHAR) AS id, q FROM events, (SELECT quantile_cont(value, 0.99) AS q FROM events)
                 WHERE value > q)
    SELECT 'large_transactions' AS type, COUNT(*) AS count, round(MAX(q), 6) AS threshold,
           (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM hit ORDER BY id LIMIT 10)) AS sample_ids FROM hit""")
def det_large_q99(spark, folder):
    """Batch variant with its ten sample rows."""
    df = txn_events(spark, folder)
    rules = D.row_rules(df, D.BATCH, ["large_transactions"])
    sampled = D.with_samples(D.count_rules(df, rules), D.tagged_rows(df, rules),
                             D.sample_columns(df, "large_transactions"), "TransactionID")
    ids = F.array_join(F.transform("sample", lambda row: row["TransactionID"]), ",")
    return sampled.select("type", "count", F.round("threshold", 6).alias("threshold"), ids.alias("sample_ids"))


@query("det_velocity", f"""
    SELECT TransactionID, CustomerID, TransactionDate, CAST(round(gap * 6e7) AS BIGINT) AS gap_micros FROM {GAPS} WHERE gap < 5""")
def det_velocity(spark, folder):
    df = txn_events(spark, folder).select("TransactionID", "CustomerID", "TransactionDate")
    return D.rapid_rows(df).withColumn("gap_micros", F.round(F.col("gap_minutes") * 6e7).cast("bigint")).drop("gap_minutes")


@query("det_branch_large_ratio", f"""
    SELECT Location, Date, round(LargeTransactionCount / TransactionCount, 6) AS LargeTransactionRatio, TransactionCount
    FROM {ORDER_SUMMARIES} WHERE LargeTransactionCount / TransactionCount > 0.15""")
def det_branch_large_ratio(spark, folder):
    days = D.large_ratio_days(order_summaries(spark, folder))
    return days.select("Location", "Date", F.round("LargeTransactionRatio", 6).alias("LargeTransactionRatio"), "TransactionCount")


@query("det_branch_volume", f"""
    WITH s AS {ORDER_SUMMARIES},
         g AS (SELECT Location, AVG(TransactionCount) AS m, COALESCE(STDDEV_SAMP(TransactionCount), 1) AS d FROM s GROUP BY 1),
         o AS (SELECT s.*, m, d, ROW_NUMBER() OVER (PARTITION BY s.Location ORDER BY Date) AS r
               FROM s JOIN g USING (Location) WHERE abs(TransactionCount - m) > 2 * d)
    SELECT Location AS entity, CAST(Date AS VARCHAR) AS event_date, TransactionCount AS actual_count,
           CAST(trunc(m) AS BIGINT) AS expected_count, round(d, 6) AS std_deviation FROM o WHERE r = 1""")
def det_branch_volume(spark, folder):
    found = D.unusual_volume(order_summaries(spark, folder))
    return found.select("entity", "event_date", "actual_count", "expected_count", F.round("std_deviation", 6).alias("std_deviation"))


@query("det_flag_columns", f"""
    SELECT 'events_FraudFlag' AS type, 'medium' AS severity, COUNT(*) AS count FROM {TXN_EVENTS} WHERE FraudFlag
    UNION ALL
    SELECT 'events_AlertLevel', 'medium', COUNT(*) FROM {TXN_EVENTS} WHERE LoginAttempts > 0""")
def det_flag_columns(spark, folder):
    df = txn_events(spark, folder).withColumns({"AlertLevel": F.col("LoginAttempts"), "AlertText": F.col("Location")})
    return D.flag_columns(df, "events").select("type", "severity", "count")


def _fence_sql(table, column, dataset):
    parts = []
    for side, fence, op in (("high", "h + 3 * (h - l)", ">"), ("low", "l - 3 * (h - l)", "<")):
        parts.append(f"""
    SELECT '{dataset}_{column}_extreme_{side}' AS type, COUNT(*) FILTER (WHERE {column} {op} {fence}) AS count,
           round(MAX({fence}), 6) AS threshold, COUNT(*) FILTER (WHERE {column} {op} {fence}) > COUNT(*) * 0.01 AS fired
    FROM {table}, (SELECT quantile_cont({column}, 0.05) AS l, quantile_cont({column}, 0.95) AS h FROM {table})""")
    return " UNION ALL ".join(parts)


@query("det_extremes", " UNION ALL ".join(_fence_sql("lineitem", c, "lineitem") for c in
                                         ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def det_extremes(spark, folder):
    """Fences of every numeric column of line items whose name doesn't speak of an id or index."""
    fences = D.extreme_fences(spark.read.parquet(f"{folder}/lineitem.parquet"), "lineitem")
    return fences.select("type", "count", F.round("threshold", 6).alias("threshold"), "fired")


@query("det_top_locations", TOP3.strip("()").replace("AS n", "AS transactions").replace("Location, COUNT", "Location AS location, COUNT")
       .replace("ORDER BY n DESC", "ORDER BY transactions DESC"))
def det_top_locations(spark, folder):
    return D.top_locations(txn_events(spark, folder), 3)


@query("det_location_distribution", f"""
    SELECT Location AS location, COUNT(*) AS transactions FROM {TXN_EVENTS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def det_location_distribution(spark, folder):
    insight = D.location_insights(txn_events(spark, folder))
    return insight.select(F.explode("location_distribution").alias("location", "transactions"))


@query("det_overview", f"""
    SELECT 'transactions_overview' AS type, COUNT(*) AS count, round(AVG(TransactionAmount), 9) AS avg_amount,
           'Analyzed ' || COUNT(*) || ' transactions with average amount ' || printf('%.2f', AVG(TransactionAmount))
             || ' from ' || COUNT(DISTINCT Location) || ' locations' AS details,
           (SELECT string_agg(Location, ',' ORDER BY Location) FROM
              (SELECT DISTINCT Location FROM {TXN_EVENTS} ORDER BY 1 LIMIT 5)) AS locations
    FROM {TXN_EVENTS}""")
def det_overview(spark, folder):
    row = D.overview(txn_events(spark, folder))
    return row.select("type", "count", F.round("avg_amount", 9).alias("avg_amount"), "details",
                      F.array_join("top_locations", ",").alias("locations"))


@query("det_general_insight", f"""
    SELECT 'general_insight' AS type, 'low' AS severity, COUNT(*) AS count, round(AVG(TransactionAmount), 9) AS avg_amount,
           'Analysis of ' || COUNT(*) || ' uploaded transaction records' AS details,
           (SELECT string_agg(Location, ',' ORDER BY Location) FROM
              (SELECT DISTINCT Location FROM {TXN_EVENTS} ORDER BY 1 LIMIT 5)) AS locations
    FROM {TXN_EVENTS}""")
def det_general_insight(spark, folder):
    row = D.general_insight(txn_events(spark, folder))
    return row.select("type", "severity", "count", F.round("avg_amount", 9).alias("avg_amount"), "details",
                      F.array_join("top_locations", ",").alias("locations"))


@query("det_all", " UNION ALL ".join([LARGE_SQL.format(q=0.95), FRAUD_SQL, LOGIN_SQL, NIGHT_SQL, VELOCITY_SQL, PLACES_SQL]))
def det_all(spark, folder):
    return short(D.detect_upload(txn_events(spark, folder)))
