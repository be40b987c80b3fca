"""Registered queries of readers, sinks and whole jobs. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.operators import summary as S
from alertlake.plans import jobs
from alertlake.plans.alert_queries import ANOMALIES, alerts
from alertlake.plans.catalog import query
from alertlake.plans.views import (DAILY_ALERT_COUNTS, METRIC_LOGS, ORDER_SUMMARIES, RUN_ID, TXN_EVENTS, daily_alert_counts,
                                   metric_logs, order_summaries, table, txn_events, txn_orders)
from alertlake.sources import quarantine as Q
from alertlake.sources import readers as R
from alertlake.sources import sinks
from alertlake.workspace import new_folder, store


@query("src_csv_roundtrip", f"""
    SELECT TransactionID, CustomerID, TransactionAmount, TransactionDate, CASE WHEN Location <> 'view' THEN Location END AS Location,
           LoginAttempts FROM {TXN_EVENTS}""")
def src_csv_roundtrip(spark, folder):
    """Transactions through CSV, with ``null`` cells for one location."""
    path = new_folder(spark, "csv")
    place = F.when(F.col("Location") == "view", "null").otherwise(F.col("Location"))
    out = txn_events(spark, folder).select(
        "TransactionID", "CustomerID", "TransactionAmount", F.date_format("TransactionDate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("TransactionDate"),
        place.alias("Location"), "LoginAttempts")
    out.write.option("header", True).csv(path)
    return R.read_transactions_csv(spark, path)


@query("src_mixed_headers", f"""
    SELECT TransactionID, CustomerID, TransactionAmount, Location, CASE WHEN Location IN ('click', 'view') THEN Channel END AS Channel FROM {TXN_EVENTS}""")
def src_mixed_headers(spark, folder):
    """One folder of files with two headers: other columns, in another order."""
    path, rows = new_folder(spark, "mixed"), txn_events(spark, folder)
    some = F.col("Location").isin("click", "view")
    rows.where(some).select("TransactionID", "Location", "CustomerID", "TransactionAmount", "Channel").write.option("header", True).csv(f"{path}/new")
    rows.where(~some).select("TransactionID", "CustomerID", "TransactionAmount", "Location").write.option("header", True).csv(f"{path}/old")
    return R.read_transactions_csv(spark, path).select("TransactionID", "CustomerID", "TransactionAmount", "Location", "Channel")


@query("src_unreadable", """
    SELECT 'orders' AS dataset, o_orderstatus AS part, COUNT(*) AS records FROM orders GROUP BY 2
    UNION ALL SELECT 'events', NULL, NULL""")
def src_unreadable(spark, folder):
    """Datasets of a folder that cannot be read are told, beside the rows of those that can."""
    path = new_folder(spark, "unreadable")
    table(spark, folder, "orders").write.parquet(f"{path}/processed_orders.parquet")
    table(spark, folder, "events").write.option("header", True).csv(f"{path}/processed_events.parquet")
    found, failed = R.scan_datasets(spark, path, ".parquet")
    counted = [df.groupBy(F.lit(name).alias("dataset"), F.col("o_orderstatus").alias("part")).agg(F.count(F.lit(1)).alias("records"))
               for name, df in found.items()]
    return D.union_all([*counted, failed.select("dataset", F.lit(None).cast("string").alias("part"), F.lit(None).cast("bigint").alias("records"))])


ORDER_LINE = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate date, o_orderstatus string"


@query("src_quarantine", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS o_totalprice,
           CASE WHEN o_orderkey % 11 = 0 THEN 'cells' WHEN o_orderkey % 35 = 0 THEN 'o_totalprice,o_orderdate'
                WHEN o_orderkey % 7 = 0 THEN 'o_totalprice' WHEN o_orderkey % 5 = 0 THEN 'o_orderdate' END AS reason FROM orders""")
def src_quarantine(spark, folder):
    """Orders as lines, some with cells that aren't numbers or dates and some cut short: good rows and the quarantine, each row once."""
    path, key = new_folder(spark, "quarantine"), F.col("o_orderkey")
    price = F.when(key % 7 == 0, "n/a").otherwise(F.round("o_totalprice", 2).cast("string"))
    day = F.when(key % 5 == 0, "soon").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    whole = F.concat_ws(",", key, "o_custkey", price, day, "o_orderstatus")
    lines = F.when(key % 11 == 0, F.concat_ws(",", key, "o_custkey")).otherwise(whole)
    table(spark, folder, "orders").select(lines.alias("value")).write.text(path)
    good, broken = Q.sorted_out(spark, path, spark.createDataFrame([], ORDER_LINE).schema, header=False)
    return good.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.lit(None).cast("string").alias("reason")).unionByName(
        broken.select(F.split_part("record", F.lit(","), F.lit(1)).cast("bigint").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"), "reason"))


@query("src_broken_files", """
    SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, CAST(NULL AS VARCHAR) AS reason FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT NULL, NULL, 'footer' FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus = 'P')""")
def src_broken_files(spark, folder):
    """A folder in which one file isn't what its place says: the rows of the whole files, and the broken file."""
    path, orders = new_folder(spark, "broken"), table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    orders.where("o_orderstatus <> 'P'").write.parquet(path)
    orders.where("o_orderstatus = 'P'").groupBy("o_orderstatus").count().coalesce(1).write.mode("append").csv(path)
    rows, broken = Q.read_whole_files(spark, path, orders.schema, store(Q.checked_files(spark, path, orders.schema), "checked-files"))
    return rows.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.lit(None).cast("string").alias("reason")).unionByName(
        broken.select(F.lit(None).cast("bigint").alias("o_orderkey"), F.lit(None).cast("double").alias("o_totalprice"), "reason"))


@query("src_dataset_catalog", f"""
    SELECT 'events' AS dataset, COUNT(*) AS records FROM {TXN_EVENTS} UNION ALL
    SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'branch_summaries', COUNT(*) FROM {ORDER_SUMMARIES}""")
def src_dataset_catalog(spark, folder):
    """Every processed dataset of a folder and its size."""
    path = new_folder(spark, "catalog")
    txn_events(spark, folder).write.option("header", True).csv(f"{path}/processed_events.csv")
    table(spark, folder, "orders").write.option("header", True).csv(f"{path}/processed_orders.csv")
    order_summaries(spark, folder).write.option("header", True).csv(f"{path}/branch_summaries.csv")
    found = R.read_datasets(spark, path)
    return D.union_all([df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("records")) for name, df in found.items()])


def written_log(spark, folder, kind, rows):
    path = new_folder(spark, f"log-{kind}")
    sinks.append_log(rows, path, kind)
    return R.read_log(spark, path, kind)


@query("src_jsonl_logs", f"""
    SELECT timestamp, query_id, alert_quality, is_accurate, is_actionable, CAST(NULL AS VARCHAR) AS user_comments FROM {METRIC_LOGS}""")
def src_jsonl_logs(spark, folder):
    return written_log(spark, folder, "feedback", metric_logs(spark, folder)).drop("log_date", "valid")


@query("log_perf_append", f"""
    SELECT query_type, CAST(timestamp AS DATE) AS log_date, 2 * COUNT(*) AS records, round(2 * SUM(response_time_seconds), 2) AS seconds
    FROM {METRIC_LOGS} GROUP BY 1, 2""")
def log_perf_append(spark, folder):
    """Two appends of the same records, read back as one log."""
    path = new_folder(spark, "log-performance")
    for _ in range(2):
        sinks.append_log(metric_logs(spark, folder), path, "performance")
    log = R.read_log(spark, path, "performance")
    return log.groupBy("query_type", F.to_date("timestamp").alias("log_date")).agg(
        F.count(F.lit(1)).alias("records"), F.round(F.sum("response_time_seconds"), 2).alias("seconds"))


@query("log_usage_totals", f"""
    SELECT timestamp, query_id, tokens_prompt, tokens_completion, tokens_prompt + tokens_completion AS tokens_total FROM {METRIC_LOGS}""")
def log_usage_totals(spark, folder):
    log = written_log(spark, folder, "usage", sinks.usage_records(metric_logs(spark, folder)))
    return log.select("timestamp", "query_id", "tokens_prompt", "tokens_completion", "tokens_total")


@query("log_feedback_append", f"""
    SELECT timestamp, query_id, alert_quality - 1 AS alert_quality, alert_quality - 1 BETWEEN 1 AND 5 AS valid FROM {METRIC_LOGS}""")
def log_feedback_append(spark, folder):
    """Qualities outside 1 to 5 are kept and marked."""
    shifted = metric_logs(spark, folder).withColumn("alert_quality", F.col("alert_quality") - 1)
    return written_log(spark, folder, "feedback", sinks.judged_feedback(shifted)).select("timestamp", "query_id", "alert_quality", "valid")


def two_runs(spark, folder):
    path = new_folder(spark, "alerts")
    first = alerts(spark, folder)
    sinks.save_alerts(first, path)
    later = A.basic_alerts(D.high_large_ratio(order_summaries(spark, folder)), "20240201000000")
    sinks.save_alerts(later, path)
    return spark.read.schema(first.schema).json(path)


@query("alert_roundtrip", f"""
    SELECT type, severity, CAST(count AS BIGINT) AS count, round(threshold, 6) AS threshold FROM {ANOMALIES} WHERE severity <> 'low' UNION ALL
    SELECT 'high_large_transaction_ratio', 'medium', COUNT(*), 0.15 FROM {ORDER_SUMMARIES} WHERE LargeTransactionCount / TransactionCount > 0.15""")
def alert_roundtrip(spark, folder):
    """Alerts of two runs through JSON and back."""
    return two_runs(spark, folder).select("type", "severity", F.col("anomaly.count").alias("count"),
                                          F.round("anomaly.threshold", 6).alias("threshold"))


@query("alerts_latest_run", f"""
    SELECT 'alert_1_20240201000000' AS id, 'high_large_transaction_ratio' AS type, COUNT(*) AS count
    FROM {ORDER_SUMMARIES} WHERE LargeTransactionCount / TransactionCount > 0.15""")
def alerts_latest_run(spark, folder):
    return R.latest_run(two_runs(spark, folder)).select("id", "type", F.col("anomaly.count").alias("count"))


@query("processed_snapshot", f"""
    SELECT TransactionID, TransactionAmount, month(TransactionDate) AS TransactionMonth, CASE WHEN TransactionType = 'Credit' THEN 1 ELSE 0 END AS IsCredit
    FROM {TXN_EVENTS}""")
def processed_snapshot(spark, folder):
    path = new_folder(spark, "processed")
    written = jobs.process_datasets({"transactions": txn_events(spark, folder)}, path)
    return written["transactions"].select("TransactionID", "TransactionAmount", "TransactionMonth", "IsCredit")


@query("process_all_datasets", f"""
    SELECT 'transactions' AS dataset, COUNT(*) AS records FROM {TXN_EVENTS} UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL
    SELECT 'lineitem', COUNT(*) FROM (SELECT DISTINCT * FROM lineitem) UNION ALL
    SELECT 'branch_summaries', COUNT(*) FROM (SELECT DISTINCT Location, CAST(TransactionDate AS DATE) FROM {TXN_EVENTS})""")
def process_all_datasets(spark, folder):
    """Cleaning, features and summaries of every raw dataset, written and counted."""
    raw = {"transactions": txn_events(spark, folder), "orders": table(spark, folder, "orders"),
           "lineitem": table(spark, folder, "lineitem")}
    written = jobs.process_datasets(raw, new_folder(spark, "datasets"))
    return D.union_all([df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("records")) for name, df in written.items()])


@query("timeline_months", f"SELECT date, strftime(date, '%B %Y') AS month, alert_count FROM {DAILY_ALERT_COUNTS}")
def timeline_months(spark, folder):
    """Daily counts written to one folder per month and read with the month taken from the folder's name."""
    path = new_folder(spark, "months")
    days = daily_alert_counts(spark, folder).withColumn("file", F.date_format("date", "M-yy"))
    days.write.partitionBy("file").option("header", True).csv(path)
    return R.read_monthly_counts(spark, path)
