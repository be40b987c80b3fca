"""Registered queries of cleaning, features, texts and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.functions.scalars import flag_to_boolean, is_true, parse_time
from alertlake.functions.text import summary_metadata, summary_text, transaction_metadata, transaction_text, usable_text
from alertlake.operators import clean as C
from alertlake.operators import features as X
from alertlake.operators import summary as S
from alertlake.operators.skew import with_previous
from alertlake.plans.catalog import query
from alertlake.plans.views import (CREDIT, ORDER_SUMMARIES, TXN_EVENTS, TXN_ORDERS, order_amounts, order_summaries, table,
                                   txn_events, txn_orders)

MIXED_FLAG = {"error": "TRUE", "click": "true", "view": "False", "signup": "1"}
MIXED_FLAG_SQL = "CASE event_type WHEN 'error' THEN 'TRUE' WHEN 'click' THEN 'true' WHEN 'view' THEN 'False' WHEN 'signup' THEN '1' END"


@query("flag_normalize", f"""
    SELECT event_id, COALESCE(lower({MIXED_FLAG_SQL}) = 'true', false) AS is_true,
           COALESCE(lower({MIXED_FLAG_SQL}) IN ('true', '1'), false) AS as_boolean FROM events""")
def flag_normalize(spark, folder):
    flag = F.lit(None).cast("string")
    for kind, text in MIXED_FLAG.items():
        flag = F.when(F.col("event_type") == kind, text).otherwise(flag)
    return table(spark, folder, "events").select("event_id", is_true(flag).alias("is_true"), flag_to_boolean(flag).alias("as_boolean"))


@query("date_coerce", """
    SELECT event_id, TRY_CAST(CASE event_type WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 'view' THEN strftime(ts, '%Y-%m-%d')
           WHEN 'error' THEN 'not a date' WHEN 'signup' THEN '' END AS TIMESTAMP) AS parsed FROM events""")
def date_coerce(spark, folder):
    kind = F.col("event_type")
    text = (F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == "view", F.date_format("ts", "yyyy-MM-dd"))
            .when(kind == "error", "not a date").when(kind == "signup", ""))
    return table(spark, folder, "events").select("event_id", parse_time(text).alias("parsed"))


@query("backfill_ids", """
    SELECT event_id, 'TX' || lpad(CAST(ROW_NUMBER() OVER (ORDER BY event_id) + 999 AS VARCHAR), 6, '0') AS TransactionID FROM events""")
def backfill_ids(spark, folder):
    return C.backfill_ids(table(spark, folder, "events").select("event_id"), "event_id")


@query("backfill_fraud_flag", "SELECT event_id, COALESCE(value / 300 > 0.7, false) AS FraudFlag FROM events")
def backfill_fraud_flag(spark, folder):
    scored = table(spark, folder, "events").select("event_id", (F.col("value") / 300).alias("FraudRiskScore"))
    return C.backfill_fraud_flag(scored).drop("FraudRiskScore")


def or_unknown(sql):
    return f"COALESCE({sql}, 'Unknown')"


@query("txn_text", f"""
    SELECT TransactionID, 'Transaction ' || TransactionID || ' was a ' || {or_unknown("printf('%.2f', TransactionAmount)")} || ' ' || TransactionType
        || ' transaction on ' || {or_unknown("strftime(TransactionDate, '%Y-%m-%d %H:%M:%S')")} || ' at ' || {or_unknown('Location')}
        || ' branch via ' || Channel || '. The customer is ' || {or_unknown('CAST(CustomerAge AS VARCHAR)')} || ' years old and works as a '
        || CustomerOccupation || '. The transaction took ' || TransactionDuration || ' seconds with ' || {or_unknown('CAST(LoginAttempts AS VARCHAR)')}
        || ' login attempts. Account balance after transaction was ' || printf('%.2f', AccountBalance) || '.' AS text
    FROM (SELECT * REPLACE (CASE WHEN LoginAttempts % 7 <> 1 THEN TransactionAmount END AS TransactionAmount,
              CASE WHEN LoginAttempts % 7 <> 2 THEN TransactionDate END AS TransactionDate, CASE WHEN Location <> 'view' THEN Location END AS Location,
              CASE WHEN LoginAttempts % 7 <> 3 THEN CustomerAge END AS CustomerAge, CASE WHEN LoginAttempts % 7 <> 4 THEN LoginAttempts END AS LoginAttempts)
          FROM {TXN_EVENTS})""")
def txn_text(spark, folder):
    """Sentences of all rows; some lack an amount, a time, a place, an age or a count."""
    df = txn_events(spark, folder)
    turn = F.col("LoginAttempts") % 7
    gaps = {"TransactionAmount": turn != 1, "TransactionDate": turn != 2, "Location": F.col("Location") != "view", "CustomerAge": turn != 3,
            "LoginAttempts": turn != 4}
    df = df.withColumns({name: F.when(there, F.col(name)) for name, there in gaps.items()})
    return df.select("TransactionID", transaction_text(df).alias("text"))


@query("summary_text", f"""
    SELECT Location, Date, 'Daily summary for ' || Location || ' on ' || Date || ': Processed ' || TransactionCount
        || ' transactions totaling ' || printf('%.2f', TotalAmount) || '. Average transaction amount was '
        || printf('%.2f', AverageAmount) || ' with standard deviation of '
        || printf('%.2f', COALESCE(AmountStdDev, 0)) || '. The branch had ' || CreditTransactionCount || ' credit transactions and '
        || LargeTransactionCount || ' large transactions. Average login attempts were 0.00 with maximum of 0. '
        || 'Fraud risk score: 0.0100.' AS text
    FROM {ORDER_SUMMARIES}""")
def summary_sentences(spark, folder):
    days = order_summaries(spark, folder)
    return days.select("Location", "Date", summary_text(days).alias("text"))


@query("emb_metadata", f"""
    SELECT TransactionID AS id, strftime(TransactionDate, '%Y-%m-%d %H:%M:%S') AS date, Location AS location, TransactionType AS type,
           TransactionAmount AS amount, Channel AS channel, CAST(NULL AS BIGINT) AS transaction_count,
           CAST(NULL AS DOUBLE) AS fraud_risk_score FROM {TXN_EVENTS}
    UNION ALL
    SELECT 'summary_' || Location || '_' || Date, CAST(Date AS VARCHAR), Location, NULL, NULL, NULL, TransactionCount, 0.01
    FROM {ORDER_SUMMARIES}""")
def emb_metadata(spark, folder):
    rows = txn_events(spark, folder).select(F.col("TransactionID").alias("id"), transaction_metadata().alias("m"))
    days = order_summaries(spark, folder)
    key = F.concat(F.lit("summary_"), F.col("Location"), F.lit("_"), F.col("Date").cast("string"))
    return rows.unionByName(days.select(key.alias("id"), summary_metadata(days).alias("m"))).select("id", "m.*")


@query("ctx_truncate", r"""
    SELECT doc_id, substring(text, 1, 2000) AS context FROM documents WHERE regexp_matches(text, '\S')""")
def ctx_truncate(spark, folder):
    """The context limit of the retriever: 2000 characters of each text that is not blank."""
    docs = table(spark, folder, "documents").select("doc_id", usable_text(F.col("text")).alias("context"))
    return docs.where(F.col("context").isNotNull())


@query("clean_dedup", """
    SELECT DISTINCT user_id AS CustomerID, event_type AS Location, CAST(strftime(ts, '%Y-%m-%d %H:00:00') AS TIMESTAMP) AS TransactionDate
    FROM events""")
def clean_dedup(spark, folder):
    """Events cut to the hour repeat; their times arrive as text."""
    raw = table(spark, folder, "events").select(
        F.col("user_id").alias("CustomerID"), F.col("event_type").alias("Location"),
        F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("TransactionDate"))
    return C.clean(raw)


@query("zscore_numeric", f"""
    WITH m AS (SELECT AVG(TransactionAmount) AS a, STDDEV_POP(TransactionAmount) AS sa, AVG(LoginAttempts) AS l,
                      STDDEV_POP(LoginAttempts) AS sl FROM {TXN_EVENTS})
    SELECT TransactionID, round((TransactionAmount - a) / sa, 6) AS amount_z, round((LoginAttempts - l) / sl, 6) AS logins_z
    FROM {TXN_EVENTS}, m""")
def zscore_numeric(spark, folder):
    scaled = C.standardise(txn_events(spark, folder), ["TransactionAmount", "LoginAttempts"], "_z")
    return scaled.select("TransactionID", F.round("TransactionAmount_z", 6).alias("amount_z"),
                         F.round("LoginAttempts_z", 6).alias("logins_z"))


@query("feat_dateparts", """
    SELECT o_orderkey, day(o_orderdate) AS TransactionDay, month(o_orderdate) AS TransactionMonth, year(o_orderdate) AS TransactionYear,
           isodow(o_orderdate) - 1 AS TransactionDayOfWeek, CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS IsWeekend
    FROM orders""")
def feat_dateparts(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("TransactionDate"))
    return X.date_parts(rows).drop("TransactionDate")


@query("feat_days_since_prev", """
    SELECT o_orderkey, date_diff('day', LAG(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)
           AS DaysSincePreviousTx FROM orders""")
def feat_days_since_prev(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("TransactionDate"))
    chained = with_previous(rows, "o_custkey", "TransactionDate", "o_orderkey", {"PreviousTransactionDate": "TransactionDate"})
    return X.days_since_previous(chained).select("o_orderkey", "DaysSincePreviousTx")


@query("feat_is_large", """
    SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN 1 ELSE 0 END
           AS IsLargeTransaction FROM orders""")
def feat_is_large(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("TransactionAmount"))
    return X.large_flag(rows).drop("TransactionAmount")


@query("feat_is_credit", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS IsCredit FROM orders")
def feat_is_credit(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("TransactionType"))
    return X.credit_flag(rows, CREDIT).drop("TransactionType")


@query("feat_age_group", f"""
    SELECT TransactionID, CASE WHEN CustomerAge >= 65 THEN '65+' WHEN CustomerAge >= 55 THEN '55-64' WHEN CustomerAge >= 45 THEN '45-54'
           WHEN CustomerAge >= 35 THEN '35-44' WHEN CustomerAge >= 25 THEN '25-34' WHEN CustomerAge >= 18 THEN '18-24' END AS AgeGroup
    FROM {TXN_EVENTS}""")
def feat_age_group(spark, folder):
    return X.age_bands(txn_events(spark, folder)).select("TransactionID", "AgeGroup")


SUMMARY_COLUMNS = ["TransactionCount", "TotalAmount", "AverageAmount", "AmountStdDev", "CreditTransactionCount", "LargeTransactionCount"]


def rounded(df, *keys):
    shown = {"TotalAmount": F.round("TotalAmount", 2), "AverageAmount": F.col("AverageAmount").cast("float"), "AmountStdDev": F.round("AmountStdDev", 3)}
    return df.select(*keys, *[shown[c].alias(c) if c in shown else c for c in SUMMARY_COLUMNS])


@query("branch_summary_daily", f"""
    SELECT Location, Date, TransactionCount, round(TotalAmount, 2) AS TotalAmount, CAST(AverageAmount AS FLOAT) AS AverageAmount,
           round(AmountStdDev, 3) AS AmountStdDev, CreditTransactionCount, LargeTransactionCount FROM {ORDER_SUMMARIES}""")
def branch_summary_daily(spark, folder):
    return rounded(order_summaries(spark, folder), "Location", "Date")


@query("branch_summary_rollup", f"""
    SELECT CASE WHEN GROUPING(Location) = 1 THEN 'all' WHEN GROUPING(Date) = 1 THEN 'branch' ELSE 'branch_date' END AS Level,
           Location, Date, COUNT(*) AS TransactionCount, round(SUM(TransactionAmount), 2) AS TotalAmount,
           CAST(AVG(TransactionAmount) AS FLOAT) AS AverageAmount, round(STDDEV_SAMP(TransactionAmount), 3) AS AmountStdDev,
           CAST(SUM(c) AS BIGINT) AS CreditTransactionCount, CAST(SUM(l) AS BIGINT) AS LargeTransactionCount
    FROM (SELECT Location, CAST(TransactionDate AS DATE) AS Date, TransactionAmount,
                 CASE WHEN TransactionType = 'F' THEN 1 ELSE 0 END AS c,
                 CASE WHEN TransactionAmount > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN 1 ELSE 0 END AS l
          FROM {TXN_ORDERS})
    GROUP BY GROUPING SETS ((Location, Date), (Location), ())""")
def branch_summary_rollup(spark, folder):
    rows = X.credit_flag(X.large_flag(txn_orders(spark, folder), amounts=order_amounts(spark, folder)), CREDIT)
    return rounded(S.summary_levels(rows), "Level", "Location", "Date")
