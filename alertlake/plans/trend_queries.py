"""Registered queries of timelines, trends, comparisons, set operations and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from alertlake.functions.scalars import elapsed_minutes
from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.operators import investigation as I
from alertlake.operators import patterns as P
from alertlake.operators import summary as S
from alertlake.operators.skew import DAY, HOUR, with_previous
from alertlake.plans import pattern_queries  # noqa: F401  its SQL is used below
from alertlake.plans.catalog import CATALOG, query
from alertlake.plans.views import (DAILY_ALERT_COUNTS, TXN_EVENTS, TXN_ORDERS, daily_alert_counts, order_amounts, table,
                                   txn_events, txn_orders)
from alertlake.workspace import new_folder

MIS = f"""(
    SELECT Location AS branch, CAST(date_trunc('week', TransactionDate) AS DATE) AS week, SUM(TransactionAmount) AS revenue,
           COUNT(*) AS transactions, COUNT(*) FILTER (WHERE Channel = '1-URGENT') AS complaints,
           COUNT(*) FILTER (WHERE TransactionAmount > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)) AS fraud_flags
    FROM {TXN_ORDERS} GROUP BY 1, 2)"""
MIS_CHANGE = f"""(
    SELECT *, LAG(revenue) OVER (PARTITION BY branch ORDER BY week) AS previous_revenue,
           round((revenue - LAG(revenue) OVER (PARTITION BY branch ORDER BY week))
                 / LAG(revenue) OVER (PARTITION BY branch ORDER BY week) * 100, 2) + 0.0 AS revenue_change_pct FROM {MIS})"""


SQL_OF = {name: q.sql for name, q in CATALOG.items() if name.startswith("pat_")}


def weekly(spark, folder):
    report = S.weekly_report(txn_orders(spark, folder), F.col("Channel") == "1-URGENT", amounts=order_amounts(spark, folder))
    return S.period_change(report, "revenue")


@query("mis_rule_labels", f"""
    SELECT branch, week, complaints, fraud_flags, COALESCE(nullif(concat_ws('; ',
             CASE WHEN revenue_change_pct <= -20 THEN 'Significant revenue drop' END,
             CASE WHEN complaints > 30 THEN 'Spike in customer complaints' END,
             CASE WHEN fraud_flags > 0 THEN 'Potential fraud detected' END), ''), 'No significant issues') AS alert_summary
    FROM {MIS_CHANGE}""")
def mis_rule_labels(spark, folder):
    return S.label_report(weekly(spark, folder)).select("branch", "week", "complaints", "fraud_flags", "alert_summary")


@query("mis_revenue_change", f"""
    SELECT branch, week, round(revenue, 2) AS revenue, transactions, round(previous_revenue, 2) AS previous_revenue, revenue_change_pct
    FROM {MIS_CHANGE}""")
def mis_revenue_change(spark, folder):
    return weekly(spark, folder).select("branch", "week", F.round("revenue", 2).alias("revenue"), "transactions",
                                        F.round("previous_revenue", 2).alias("previous_revenue"), "revenue_change_pct")


def standing(df):
    """Number the rows of a sorted table of a few rows as they stand."""
    return df.coalesce(1).withColumn("position", F.monotonically_increasing_id() + 1)


def labelled_days(spark, folder):
    return daily_alert_counts(spark, folder).withColumn("month", F.date_format("date", "MMMM yyyy"))


LABELLED_DAYS = f"(SELECT date, strftime(date, '%B %Y') AS month, alert_count FROM {DAILY_ALERT_COUNTS})"


@query("timeline_breaches", f"SELECT date, month, alert_count, 60 AS threshold FROM {LABELLED_DAYS} WHERE alert_count > 60")
def timeline_breaches(spark, folder):
    return S.breaches(labelled_days(spark, folder), 60)


@query("timeline_sorted", f"SELECT date, month, alert_count, ROW_NUMBER() OVER (ORDER BY date DESC) AS position FROM {LABELLED_DAYS}")
def timeline_sorted(spark, folder):
    """Newest day first; the position is where a row stands in the sorted table."""
    days = labelled_days(spark, folder).select("date", "month", "alert_count").orderBy(F.desc("date"))
    return standing(days)


@query("branch_trend", " UNION ALL ".join(f"""
    SELECT '{p}' AS period, Location AS branch, CAST(date_trunc('{p}', TransactionDate) AS DATE) AS period_start,
           COUNT(*) AS transactions, round(SUM(TransactionAmount), 2) AS total_amount, CAST(AVG(TransactionAmount) AS FLOAT) AS average_amount
    FROM {TXN_ORDERS} GROUP BY 2, 3""" for p in S.PERIODS))
def branch_trend(spark, folder):
    """All five periods."""
    return S.branch_trends(txn_orders(spark, folder)).withColumns({
        "total_amount": F.round("total_amount", 2), "average_amount": F.col("average_amount").cast("float")})


@query("branch_compare", f"""
    WITH t AS (SELECT Location, CAST(date_trunc('month', TransactionDate) AS DATE) AS period_start, COUNT(*) AS n, SUM(TransactionAmount) AS s
               FROM {TXN_ORDERS} GROUP BY 1, 2),
         a AS (SELECT * FROM t WHERE Location = 'NATION_1'), b AS (SELECT * FROM t WHERE Location = 'NATION_2')
    SELECT COALESCE(a.period_start, b.period_start) AS period_start, a.n AS a_transactions, round(a.s, 2) AS a_total, b.n AS b_transactions,
           round(b.s, 2) AS b_total, COALESCE(a.n, 0) - COALESCE(b.n, 0) AS transactions_difference,
           round(COALESCE(a.s, 0) - COALESCE(b.s, 0), 2) AS total_difference
    FROM a FULL JOIN b ON a.period_start = b.period_start""")
def branch_compare(spark, folder):
    wide = S.compare_branches(txn_orders(spark, folder), "NATION_1", "NATION_2")
    return wide.withColumns({c: F.round(c, 2) for c in ("a_total", "b_total", "total_difference")})


BRANCH = f"(SELECT * FROM {TXN_ORDERS} WHERE Location = 'NATION_1')"


@query("branch_overview", f"""
    SELECT Location, COUNT(*) AS TransactionCount, round(SUM(TransactionAmount), 2) AS TotalAmount,
           CAST(AVG(TransactionAmount) AS FLOAT) AS AverageAmount, round(STDDEV_SAMP(TransactionAmount), 3) AS AmountStdDev,
           MIN(TransactionDate) AS FirstSeen, MAX(TransactionDate) AS LastSeen,
           (SELECT string_agg(type, ',' ORDER BY type) FROM (
                SELECT 'large_transactions' AS type, COUNT(*) AS n FROM {BRANCH} WHERE TransactionAmount > (SELECT quantile_cont(TransactionAmount, 0.95) FROM {BRANCH})
                UNION ALL SELECT 'overnight_transactions', COUNT(*) FROM {BRANCH} WHERE hour(TransactionDate) < 5
                UNION ALL SELECT 'velocity_anomaly', COUNT(*) FROM (SELECT TransactionDate - LAG(TransactionDate) OVER
                    (PARTITION BY CustomerID ORDER BY TransactionDate, TransactionID) AS gap FROM {BRANCH}) WHERE gap < INTERVAL 5 MINUTE
                UNION ALL SELECT 'location_insights', COUNT(*) FROM {BRANCH}) WHERE n > 0) AS alerts
    FROM {TXN_ORDERS} WHERE Location = 'NATION_1' GROUP BY 1""")
def branch_overview(spark, folder):
    """A branch's summary with the kinds of alerts its rows give."""
    df = txn_orders(spark, folder)
    alerts = A.basic_alerts(D.detect_upload(S.of_branch(df, "NATION_1")), "20240131000000", 0.0)
    row = S.branch_overview(df, "NATION_1", alerts).withColumn("alerts", F.array_join(F.sort_array(F.map_keys("alerts")), ","))
    return row.withColumns({"TotalAmount": F.round("TotalAmount", 2), "AverageAmount": F.col("AverageAmount").cast("float"),
                            "AmountStdDev": F.round("AmountStdDev", 3)})


@query("branch_list", f"SELECT DISTINCT Location AS branch FROM {TXN_ORDERS}")
def branch_list(spark, folder):
    return S.branch_list(txn_orders(spark, folder))


RULE_ROWS = f"""(
    SELECT *, 'fraud_flags' AS anomaly_type FROM {TXN_EVENTS} WHERE FraudFlag
    UNION ALL SELECT *, 'high_login_attempts' FROM {TXN_EVENTS} WHERE LoginAttempts > 5
    UNION ALL SELECT *, 'large_transactions' FROM {TXN_EVENTS} WHERE TransactionAmount > (SELECT quantile_cont(value, 0.95) FROM events)
    UNION ALL SELECT *, 'overnight_transactions' FROM {TXN_EVENTS} WHERE hour(TransactionDate) < 5)"""
GAP_ROWS = f"""(
    SELECT TransactionID, CustomerID, TransactionDate, date_diff('microsecond', LAG(TransactionDate)
           OVER (PARTITION BY CustomerID ORDER BY TransactionDate, TransactionID), TransactionDate) / 6e7 AS gap FROM {TXN_EVENTS})"""


def found_patterns(df):
    """The pattern rules, with limits that fit the events."""
    return {
        "night_activity": P.night_activity(df), "burst": P.bursts(df, at_least=3, minutes=60), "structuring": P.structuring(df, limit=100, share=0.9),
        "round_amounts": P.round_amounts(df, unit=10, whole_part=True), "location_jump": P.location_jumps(df),
        "new_account": P.large_first(df, at_least=50), "long_session": P.session_extremes(df, logins=90, duration=380),
        "cross_border": P.cross_border(df, ["signup", "error"], 200), "takeover": P.takeovers(df, tiny=5, large=100),
        "customer_deviation": P.customer_deviations(df)}


def of_customers(name, sql):
    return f"SELECT TransactionID, '{name}' AS anomaly_type FROM {TXN_EVENTS} WHERE CustomerID IN (SELECT CustomerID FROM ({sql}))"


def of_rows(name, sql):
    return f"SELECT TransactionID, '{name}' AS anomaly_type FROM ({sql})"


INVESTIGATED = f"""
    WITH tags AS (
        SELECT TransactionID, anomaly_type FROM {RULE_ROWS}
        UNION SELECT TransactionID, 'velocity_anomaly' FROM {GAP_ROWS} WHERE gap < 5
        UNION {of_customers('night_activity', SQL_OF['pat_night'])} UNION {of_rows('burst', SQL_OF['pat_burst'])}
        UNION {of_customers('structuring', SQL_OF['pat_structuring'])} UNION {of_customers('round_amounts', SQL_OF['pat_round'])}
        UNION {of_rows('location_jump', SQL_OF['pat_location_jump'])} UNION {of_rows('new_account', SQL_OF['pat_new_account'])}
        UNION {of_rows('long_session', SQL_OF['pat_session'])} UNION {of_rows('cross_border', SQL_OF['pat_cross_border'])}
        UNION {of_rows('takeover', SQL_OF['pat_takeover'])} UNION {of_rows('customer_deviation', SQL_OF['pat_customer_z'])}),
    broken AS (SELECT TransactionID, string_agg(anomaly_type, ',' ORDER BY anomaly_type) AS rules FROM tags GROUP BY 1)
    SELECT t.TransactionID, t.TransactionAmount, COALESCE(rules, '') AS broken_rules FROM {TXN_EVENTS} t LEFT JOIN broken USING (TransactionID)"""


@query("txn_investigate", INVESTIGATED + f"""
    WHERE t.TransactionID IN (SELECT TransactionID FROM {GAP_ROWS} WHERE gap < 5)""")
def txn_investigate(spark, folder):
    """Investigate the transactions that came in rapid succession: the row rules, succession itself, and every pattern."""
    df = txn_events(spark, folder)
    rapid = D.rapid_rows(df)
    tagged = [D.tagged_rows(df, D.row_rules(df)), rapid.withColumn("anomaly_type", F.lit("velocity_anomaly")), A.pattern_tags(df, found_patterns(df))]
    found = A.investigate(df, tagged, rapid)
    return found.select("TransactionID", "TransactionAmount", F.array_join("broken_rules", ",").alias("broken_rules"))


def looks():
    """The rules of ``found_patterns`` with the time each of them looks back."""
    back = {"burst": HOUR, "location_jump": 6 * HOUR, "takeover": 24 * HOUR, "long_session": 0, "cross_border": 0}
    names = ("night_activity", "burst", "structuring", "round_amounts", "location_jump", "new_account", "long_session", "cross_border",
             "takeover", "customer_deviation")
    return {name: I.Look(lambda rows, name=name: found_patterns(rows)[name], back.get(name)) for name in names}


@query("txn_investigate_ids", INVESTIGATED + f"""
    WHERE t.TransactionID IN (SELECT TransactionID FROM {TXN_EVENTS} ORDER BY TransactionAmount DESC, TransactionID LIMIT 20)""")
def txn_investigate_ids(spark, folder):
    """Investigate the twenty largest transactions by their ids: each rule reads the rows of their customers it can look back to."""
    path = I.write_snapshot(txn_events(spark, folder), new_folder(spark, "snapshot"))
    largest = txn_events(spark, folder).orderBy(F.desc("TransactionAmount"), "TransactionID").select("TransactionID").limit(20)
    found = I.investigate_ids(spark, path, [r[0] for r in largest.collect()], looks())
    return found.select("TransactionID", "TransactionAmount", F.array_join("broken_rules", ",").alias("broken_rules"))


@query("join_semi_related", f"""
    SELECT TransactionID, CustomerID, Location FROM {TXN_EVENTS} WHERE TransactionID IN (SELECT TransactionID FROM {GAP_ROWS} WHERE gap < 5)""")
def join_semi_related(spark, folder):
    df = txn_events(spark, folder)
    return df.join(D.rapid_rows(df).select("TransactionID"), "TransactionID", "left_semi").select("TransactionID", "CustomerID", "Location")


@query("join_semi_toploc", f"""
    SELECT TransactionID, Location FROM {TXN_ORDERS} WHERE Location IN (
        SELECT Location FROM {TXN_ORDERS} GROUP BY 1 ORDER BY COUNT(*) DESC, Location LIMIT 3)""")
def join_semi_toploc(spark, folder):
    df = txn_orders(spark, folder)
    top = D.top_locations(df, 3)
    # Three rows by construction.
    return df.join(F.broadcast(top), df["Location"] == top["location"], "left_semi").select("TransactionID", "Location")


@query("merge_union", f"""
    SELECT TransactionID, CustomerID, TransactionAmount, AccountBalance, LoginAttempts FROM {TXN_EVENTS}
    UNION ALL SELECT TransactionID, CustomerID, TransactionAmount, AccountBalance, NULL FROM {TXN_ORDERS}""")
def merge_union(spark, folder):
    """Old and new rows by column name; columns only one side has are filled with NULL."""
    both = txn_events(spark, folder).unionByName(txn_orders(spark, folder), allowMissingColumns=True)
    return both.select("TransactionID", "CustomerID", "TransactionAmount", "AccountBalance", "LoginAttempts")


@query("win_lag_gap", f"SELECT TransactionID, CAST(round(gap * 6e7) AS BIGINT) AS gap_micros FROM {GAP_ROWS}")
def win_lag_gap(spark, folder):
    """Minutes since the customer's previous row, however long ago."""
    df = txn_events(spark, folder).select("TransactionID", "CustomerID", "TransactionDate")
    chained = with_previous(df, "CustomerID", "TransactionDate", "TransactionID", {"previous": "TransactionDate"}, DAY)
    gap = elapsed_minutes(F.col("previous"), F.col("TransactionDate"))
    return chained.select("TransactionID", F.round(gap * 6e7).cast("bigint").alias("gap_micros"))


@query("topk_per_group", f"""
    SELECT Location, TransactionID, TransactionAmount, rank FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY Location ORDER BY TransactionAmount DESC, TransactionID) AS rank FROM {TXN_ORDERS})
    WHERE rank <= 10""")
def topk_per_group(spark, folder):
    """Ten largest per branch; the rank limit is also applied before the shuffle."""
    order = Window.partitionBy("Location").orderBy(F.desc("TransactionAmount"), "TransactionID")
    ranked = txn_orders(spark, folder).select("Location", "TransactionID", "TransactionAmount", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= 10)
