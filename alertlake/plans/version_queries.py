"""Registered queries of versions and lineage. Orders give three snapshots by date, events a lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import versions as V
from alertlake.plans import jobs
from alertlake.plans.catalog import query
from alertlake.plans.views import CREDIT, RUN_ID, TXN_ORDERS, table, txn_orders
from alertlake.workspace import new_folder, store

CUTS = {"v1.0.0": "1997-01-01", "v2.0.0": "1999-01-01", "v3.0.0": "2100-01-01"}


def filled_store(spark, folder):
    """A store with a version per cut; every version holds all orders before its date."""
    kept = V.VersionStore(spark, new_folder(spark, "versions"))
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").alias("TransactionAmount"), F.col("o_orderdate").alias("TransactionDate"))
    for i, (version, cut) in enumerate(CUTS.items()):
        kept.create(f"orders before {cut}", f"2024-01-0{i + 1} 00:00:00", rows.where(F.col("TransactionDate") < F.lit(cut).cast("timestamp_ntz")), i > 0)
    return kept


@query("versions_list", """
    SELECT version, parent_version, processed_records FROM (VALUES ('v1.0.0', 'v0.0.0', '1997-01-01'), ('v2.0.0', 'v1.0.0', '1999-01-01'),
        ('v3.0.0', 'v2.0.0', '2100-01-01')) t(version, parent_version, cut),
        LATERAL (SELECT COUNT(*) AS processed_records FROM orders WHERE o_orderdate < CAST(cut AS TIMESTAMP))""")
def versions_list(spark, folder):
    return filled_store(spark, folder).versions().select("version", "parent_version", "processed_records")


@query("version_summary", """
    SELECT version, processed_records, 1 AS files, merged FROM (VALUES ('v1.0.0', 'No', '1997-01-01'), ('v2.0.0', 'Yes', '1999-01-01'),
        ('v3.0.0', 'Yes', '2100-01-01')) t(version, merged, cut),
        LATERAL (SELECT COUNT(*) AS processed_records FROM orders WHERE o_orderdate < CAST(cut AS TIMESTAMP))""")
def version_summary(spark, folder):
    return V.version_summary(filled_store(spark, folder).versions()).select("version", "processed_records", "files", "merged")


@query("version_as_of", "SELECT o_orderkey AS TransactionID, o_totalprice AS TransactionAmount FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'")
def version_as_of(spark, folder):
    """Rows current after rolling back from the third version to the second."""
    kept = filled_store(spark, folder)
    kept.rollback("v2.0.0", "2024-01-04 00:00:00")
    return kept.as_of().select("TransactionID", "TransactionAmount")


@query("version_new_ids", """
    SELECT o_orderkey AS TransactionID FROM orders WHERE o_orderdate < TIMESTAMP '2100-01-01'
    EXCEPT SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'""")
def version_new_ids(spark, folder):
    kept = filled_store(spark, folder)
    return V.new_ids(kept.as_of("v2.0.0"), kept.as_of("v3.0.0"))


@query("version_compare", """
    WITH n AS (SELECT COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS a, COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS b,
                      COUNT(*) AS c FROM orders)
    SELECT 'v1.0.0' AS version_a, 'v2.0.0' AS version_b, CAST(1 AS DOUBLE) AS time_difference_days, b - a AS transaction_count_difference,
           b - a AS new_records_count, 'B is direct descendant of A' AS lineage_relation FROM n
    UNION ALL SELECT 'v3.0.0', 'v2.0.0', -1, b - c, 0, 'A is direct descendant of B' FROM n
    UNION ALL SELECT 'v1.0.0', 'v3.0.0', 2, c - a, c - a, 'Common ancestors: v0.0.0, v1.0.0' FROM n""")
def version_compare(spark, folder):
    kept = filled_store(spark, folder)
    pairs = [("v1.0.0", "v2.0.0"), ("v3.0.0", "v2.0.0"), ("v1.0.0", "v3.0.0")]
    found = [kept.compare(a, b) for a, b in pairs]
    return found[0].unionByName(found[1]).unionByName(found[2]).select(
        "version_a", "version_b", "time_difference_days", "transaction_count_difference", "new_records_count", "lineage_relation")


@query("next_version", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'v' || strftime(o_orderdate, '%Y%m%d%H%M%S') ELSE 'v' || (o_custkey + 1) || '.0.0' END AS version
    FROM orders""")
def next_version(spark, folder):
    """A version after each order's own; those of pending orders do not parse."""
    parts = F.concat(F.lit("v"), F.col("o_custkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 7).cast("string"), F.lit("."),
                     (F.col("o_orderkey") % 3).cast("string"))
    current = F.when(F.col("o_orderstatus") == "P", F.lit("draft")).otherwise(parts)
    return table(spark, folder, "orders").select(
        "o_orderkey", V.following_version(current, F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("version"))


def event_lineage(spark, folder):
    """Every event as a version whose parent is an earlier event."""
    parent = F.col("event_id") - 1 - F.col("user_id") % 97
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("version"), F.when(parent >= 0, parent.cast("string")).alias("parent"),
        F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"))


EDGES = "(SELECT event_id AS v, CASE WHEN event_id - 1 - user_id % 97 >= 0 THEN event_id - 1 - user_id % 97 END AS p FROM events)"


def walk_sql(name, start):
    return f"{name}(v) AS (SELECT {start} UNION SELECT p FROM {name} JOIN {EDGES} e ON e.v = {name}.v WHERE p IS NOT NULL)"


@query("lineage_ancestry", f"""
    WITH RECURSIVE {walk_sql('a', '(SELECT MAX(event_id) FROM events)')} SELECT CAST(v AS VARCHAR) AS ancestor FROM a""")
def lineage_ancestry(spark, folder):
    """Ancestry of the newest version."""
    lineage = event_lineage(spark, folder)
    newest = lineage.agg(F.max_by("version", "seq").alias("version"))
    return V.ancestry(lineage, newest).select("ancestor")


@query("lineage_common", f"""
    WITH RECURSIVE {walk_sql('a', '(SELECT MAX(event_id) FROM events)')}, {walk_sql('b', "(SELECT MAX(event_id) FROM events WHERE event_type = 'signup')")}
    SELECT CAST(v AS VARCHAR) AS ancestor FROM a INTERSECT SELECT CAST(v AS VARCHAR) FROM b""")
def lineage_common(spark, folder):
    """Versions from which both the newest event and the newest signup descend."""
    lineage = event_lineage(spark, folder)
    signups = table(spark, folder, "events").where(F.col("event_type") == "signup")
    return V.common_ancestors(lineage, lineage.agg(F.max_by("version", "seq").alias("version")),
                              signups.agg(F.max("event_id").cast("string").alias("version")))


@query("versions_import", """
    SELECT o_orderkey, 'v1.0.0' AS version, 'v0.0.0' AS parent_version, o_orderdate AS created_at, o_orderpriority AS notes,
           CAST(NULL AS BIGINT) AS processed_records, false AS is_current FROM orders
    UNION ALL SELECT o_orderkey, 'v2.0.0', 'v1.0.0', o_orderdate, o_orderpriority, o_custkey, true FROM orders""")
def versions_import(spark, folder):
    """A version document per order, imported as rows."""
    created = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    info = F.struct(F.col("o_custkey").alias("processed_records"))
    first = F.struct(created.alias("created_at"), F.col("o_orderpriority").alias("notes"), F.lit("v0.0.0").alias("parent_version"),
                     F.lit(None).cast("struct<processed_records:bigint>").alias("processing_info"))
    second = F.struct(created.alias("created_at"), F.col("o_orderpriority").alias("notes"), F.lit("v1.0.0").alias("parent_version"),
                      info.alias("processing_info"))
    document = F.to_json(F.struct(F.lit("v2.0.0").alias("current_version"),
                                  F.create_map(F.lit("v1.0.0"), first, F.lit("v2.0.0"), second).alias("versions")))
    versions, _ = V.import_document(table(spark, folder, "orders").select("o_orderkey", document.alias("document")))
    return versions.select("o_orderkey", "version", "parent_version", "created_at", "notes", "processed_records", "is_current")


NEW = f"(SELECT * FROM {TXN_ORDERS} WHERE TransactionDate >= TIMESTAMP '1999-01-01')"


@query("ingest_version", f"""SELECT * FROM (
    SELECT 'general_insight' AS type, 'low' AS severity, COUNT(*) AS count FROM {NEW} UNION ALL
    SELECT 'large_transactions', 'medium', COUNT(*) FROM {NEW} WHERE TransactionAmount > (SELECT quantile_cont(TransactionAmount, 0.95) FROM {NEW}) UNION ALL
    SELECT 'overnight_transactions', 'medium', COUNT(*) FROM {NEW} WHERE hour(TransactionDate) < 5 UNION ALL
    SELECT 'velocity_anomaly', 'high', COUNT(*) FROM (SELECT TransactionDate, LAG(TransactionDate) OVER
        (PARTITION BY CustomerID ORDER BY TransactionDate, TransactionID) AS p FROM {NEW}) WHERE TransactionDate - p < INTERVAL 5 MINUTE UNION ALL
    SELECT 'location_insights', 'low', CAST(SUM(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM {NEW} GROUP BY Location ORDER BY n DESC, Location LIMIT 3)) WHERE count > 0""")
def ingest_version(spark, folder):
    """Orders since 1999 merged into those before; alerts judge the new rows alone."""
    rows = txn_orders(spark, folder)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    done = jobs.ingest(rows.where(F.col("TransactionDate") < cut), rows.where(F.col("TransactionDate") >= cut),
                       new_folder(spark, "ingest"), "v2.0.0", RUN_ID, CREDIT)
    return done.alerts.select("type", "severity", F.col("anomaly.count").alias("count"))


SECOND = f"(SELECT * FROM {TXN_ORDERS} WHERE TransactionDate >= TIMESTAMP '1999-01-01')"


@query("ingest_twice", f"""
    WITH n AS (SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE TransactionAmount > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)) AS large FROM {TXN_ORDERS}),
         s AS (SELECT COUNT(*) AS days FROM (SELECT DISTINCT Location, CAST(TransactionDate AS DATE) FROM {TXN_ORDERS})),
         a AS (SELECT COUNT(*) AS judged FROM {SECOND})
    SELECT rows, large, days, judged, 1 AS runs, 2 AS parts FROM n, s, a""")
def ingest_twice(spark, folder):
    """Orders before 1999-06 as one version, then those since 1999 as the next: rows of both once, alerts of the second alone."""
    rows, root = txn_orders(spark, folder), new_folder(spark, "ingest-twice")
    cut, later = (F.lit(day).cast("timestamp_ntz") for day in ("1999-01-01", "1999-06-01"))
    jobs.ingest(None, rows.where(F.col("TransactionDate") < later), root, "v1.0.0", "20240130000000", CREDIT)
    done = jobs.ingest("v1.0.0", rows.where(F.col("TransactionDate") >= cut), root, "v2.0.0", RUN_ID, CREDIT)
    seen = done.transactions.agg(F.count(F.lit(1)).alias("rows"), F.sum("IsLargeTransaction").cast("bigint").alias("large"))
    days = done.summaries.agg(F.count(F.lit(1)).alias("days")).scalar()
    judged = done.alerts.agg(F.count_distinct("run_id").alias("runs"),
                             F.max(F.when(F.col("type") == "general_insight", F.col("anomaly.count"))).alias("judged"))
    parts = len(jobs.version_parts(spark, root, "v2.0.0"))
    return seen.select("rows", "large", days.alias("days"), judged.select("judged").scalar().alias("judged"), judged.select("runs").scalar().alias("runs"), F.lit(parts).alias("parts"))


@query("ingest_sparse", """
    SELECT o_orderpriority AS value, COUNT(*) AS described, COUNT(*) AS on_device FROM orders GROUP BY 1""")
def ingest_sparse(spark, folder):
    """Orders with a value in one column, then the same orders with it in the next, which are other rows, and the first ones again."""
    rows, root = txn_orders(spark, folder), new_folder(spark, "ingest-sparse")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("TransactionID"), F.col("o_orderpriority").alias("value"))
    rows = rows.select(F.col("TransactionID").cast("string").alias("TransactionID"), "TransactionDate", "TransactionAmount", "Location").join(orders, "TransactionID")
    rows = store(rows, "sparse-orders")  # both versions take all of them
    empty = F.lit(None).cast("string")
    first = rows.withColumns({"Description": F.col("value"), "DeviceID": empty}).drop("value")
    other = rows.withColumns({"Description": empty, "DeviceID": F.col("value")}).drop("value")
    jobs.ingest(None, first, root, "v1.0.0", "20240130000000", CREDIT)
    done = jobs.ingest("v1.0.0", other.unionByName(first), root, "v2.0.0", RUN_ID, CREDIT)
    return done.transactions.groupBy(F.coalesce("Description", "DeviceID").alias("value")).agg(
        F.count("Description").alias("described"), F.count("DeviceID").alias("on_device"))


@query("ingest_summaries", f"""
    SELECT Location, CAST(TransactionDate AS DATE) AS Date, COUNT(*) AS TransactionCount, round(SUM(TransactionAmount), 2) AS TotalAmount,
           CAST(round(stddev_samp(TransactionAmount), 1) AS FLOAT) AS AmountStdDev,
           CAST(COUNT(*) FILTER (WHERE TransactionAmount > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)) AS BIGINT) AS LargeTransactionCount
    FROM {TXN_ORDERS} GROUP BY 1, 2""")
def ingest_summaries(spark, folder):
    """Daily summaries of three versions of growing data, merged from what each part keeps beside its rows."""
    rows, root = txn_orders(spark, folder), new_folder(spark, "ingest-summaries")
    parts = [rows.where(F.pmod(F.xxhash64("TransactionID"), F.lit(3)) == i) for i in range(3)]
    done = None
    for i, part in enumerate(parts):
        done = jobs.ingest(f"v{i}.0.0" if i else None, part, root, f"v{i + 1}.0.0", f"2024013000000{i}", CREDIT)
    return done.summaries.select("Location", "Date", "TransactionCount", F.round("TotalAmount", 2).alias("TotalAmount"),
                                 F.round("AmountStdDev", 1).cast("float").alias("AmountStdDev"), "LargeTransactionCount")
