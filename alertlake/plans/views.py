"""The logical tables of the library, mapped from the star-schema and event tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_ID = "20240131000000"
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def txn_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as transactions."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("TransactionID"),
        F.col("user_id").cast("string").alias("CustomerID"),
        F.col("value").alias("TransactionAmount"),
        F.col("ts").alias("TransactionDate"),
        F.col("event_type").alias("TransactionType"),
        F.col("event_type").alias("Location"),
        F.concat(F.lit("channel-"), (F.col("user_id") % 5).cast("string")).alias("Channel"),
        (F.col("event_type") == "error").alias("FraudFlag"),
        k.alias("LoginAttempts"),
        (F.col("user_id") % 60 + 18).cast("int").alias("CustomerAge"),
        F.concat(F.lit("occupation-"), (F.col("user_id") % 7).cast("string")).alias("CustomerOccupation"),
        (k * 4).alias("TransactionDuration"),
        F.round(F.col("value") * 10, 2).alias("AccountBalance"),
    )


TXN_EVENTS = """(
    SELECT CAST(event_id AS VARCHAR) AS TransactionID, CAST(user_id AS VARCHAR) AS CustomerID, value AS TransactionAmount,
           ts AS TransactionDate, event_type AS TransactionType, event_type AS Location,
           'channel-' || CAST(user_id % 5 AS VARCHAR) AS Channel, event_type = 'error' AS FraudFlag,
           CAST(json_extract_string(props, '$.k') AS INTEGER) AS LoginAttempts,
           CAST(user_id % 60 + 18 AS INTEGER) AS CustomerAge, 'occupation-' || CAST(user_id % 7 AS VARCHAR) AS CustomerOccupation,
           CAST(json_extract_string(props, '$.k') AS INTEGER) * 4 AS TransactionDuration, round(value * 10, 2) AS AccountBalance
    FROM events)"""


def order_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of ``txn_orders`` without its joins, for statistics over the amount alone."""
    return table(spark, folder, "orders").select(F.col("o_totalprice").alias("TransactionAmount"))


def txn_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions of a customer at a nation's branch."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .select(
            F.col("o_orderkey").cast("string").alias("TransactionID"),
            F.col("o_custkey").cast("string").alias("CustomerID"),
            F.col("o_totalprice").alias("TransactionAmount"),
            F.col("o_orderdate").alias("TransactionDate"),
            F.col("o_orderstatus").alias("TransactionType"),
            F.col("o_orderpriority").alias("Channel"),
            F.col("n_name").alias("Location"),
            F.col("c_acctbal").alias("AccountBalance"),
        )
    )


TXN_ORDERS = """(
    SELECT CAST(o_orderkey AS VARCHAR) AS TransactionID, CAST(o_custkey AS VARCHAR) AS CustomerID,
           o_totalprice AS TransactionAmount, o_orderdate AS TransactionDate, o_orderstatus AS TransactionType,
           o_orderpriority AS Channel, n_name AS Location, c_acctbal AS AccountBalance
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

CREDIT = "F"


def order_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Branch and date summaries of ``txn_orders``."""
    from alertlake.operators.features import credit_flag, large_flag
    from alertlake.operators.summary import daily_summaries

    rows = credit_flag(large_flag(txn_orders(spark, folder), amounts=order_amounts(spark, folder)), CREDIT)
    return daily_summaries(rows)


ORDER_SUMMARIES = f"""(
    SELECT Location, CAST(TransactionDate AS DATE) AS Date, COUNT(*) AS TransactionCount, SUM(TransactionAmount) AS TotalAmount,
           AVG(TransactionAmount) AS AverageAmount, STDDEV_SAMP(TransactionAmount) AS AmountStdDev,
           CAST(SUM(CASE WHEN TransactionType = '{CREDIT}' THEN 1 ELSE 0 END) AS BIGINT) AS CreditTransactionCount,
           CAST(SUM(CASE WHEN TransactionAmount > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders) THEN 1 ELSE 0 END) AS BIGINT)
             AS LargeTransactionCount
    FROM {TXN_ORDERS} GROUP BY 1, 2)"""


def metric_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as performance, usage and feedback log records."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("query_type"),
        F.col("value").alias("response_time_seconds"), k.cast("bigint").alias("tokens_prompt"),
        (F.col("user_id") % 50).cast("bigint").alias("tokens_completion"), (k % 5 + 1).cast("int").alias("alert_quality"),
        (k % 2 == 0).alias("is_accurate"), (k % 3 == 0).alias("is_actionable"),
    )


METRIC_LOGS = """(
    SELECT ts AS timestamp, CAST(event_id AS VARCHAR) AS query_id, event_type AS query_type, value AS response_time_seconds,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_prompt, CAST(user_id % 50 AS BIGINT) AS tokens_completion,
           CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1 AS INTEGER) AS alert_quality,
           CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS is_accurate,
           CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 AS is_actionable
    FROM events)"""


def daily_alert_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Error events per day, as the daily alert counts of the timeline."""
    return (
        table(spark, folder, "events").where(F.col("event_type") == "error")
        .groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("alert_count"))
    )


DAILY_ALERT_COUNTS = """(
    SELECT CAST(ts AS DATE) AS date, COUNT(*) AS alert_count FROM events WHERE event_type = 'error' GROUP BY 1)"""
