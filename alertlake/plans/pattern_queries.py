"""Registered queries of the customer pattern rules. Limits are set for the amounts of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.operators import patterns as P
from alertlake.plans.catalog import query
from alertlake.plans.views import TXN_EVENTS, txn_events


@query("pat_night", f"""
    SELECT CustomerID, COUNT(*) AS night_count FROM {TXN_EVENTS} WHERE hour(TransactionDate) BETWEEN 1 AND 4 GROUP BY 1 HAVING COUNT(*) >= 3""")
def pat_night(spark, folder):
    return P.night_activity(txn_events(spark, folder))


@query("pat_burst", f"""
    SELECT * FROM (SELECT TransactionID, CustomerID, COUNT(*) OVER (PARTITION BY CustomerID ORDER BY TransactionDate
                   RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS burst_count FROM {TXN_EVENTS})
    WHERE burst_count >= 3""")
def pat_burst(spark, folder):
    return P.bursts(txn_events(spark, folder), at_least=3, minutes=60).select("TransactionID", "CustomerID", "burst_count")


@query("pat_structuring", f"""
    SELECT CustomerID, COUNT(*) AS near_limit_count, round(SUM(TransactionAmount), 2) AS near_limit_total FROM {TXN_EVENTS}
    WHERE TransactionAmount >= 100 * 0.9 AND TransactionAmount < 100 GROUP BY 1 HAVING COUNT(*) >= 3""")
def pat_structuring(spark, folder):
    found = P.structuring(txn_events(spark, folder), limit=100, share=0.9)
    return found.withColumn("near_limit_total", F.round("near_limit_total", 2))


@query("pat_round", f"""
    SELECT CustomerID, COUNT(*) AS round_count FROM {TXN_EVENTS}
    WHERE floor(TransactionAmount) >= 10 AND CAST(floor(TransactionAmount) AS BIGINT) % 10 = 0 GROUP BY 1 HAVING COUNT(*) >= 3""")
def pat_round(spark, folder):
    return P.round_amounts(txn_events(spark, folder), unit=10, whole_part=True)


@query("pat_location_jump", f"""
    SELECT TransactionID, CustomerID, previous_location, Location, CAST(round(h * 3.6e9) AS BIGINT) AS gap_micros FROM (
        SELECT *, LAG(Location) OVER w AS previous_location,
               date_diff('microsecond', LAG(TransactionDate) OVER w, TransactionDate) / 3.6e9 AS h
        FROM {TXN_EVENTS} WINDOW w AS (PARTITION BY CustomerID ORDER BY TransactionDate, TransactionID))
    WHERE previous_location <> Location AND h <= 6""")
def pat_location_jump(spark, folder):
    found = P.location_jumps(txn_events(spark, folder))
    return found.select("TransactionID", "CustomerID", "previous_location", "Location",
                        F.round(F.col("hours_since") * 3.6e9).cast("bigint").alias("gap_micros"))


@query("pat_new_account", f"""
    SELECT CustomerID, TransactionID, TransactionDate AS first_date, TransactionAmount AS first_amount FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY CustomerID ORDER BY TransactionDate, TransactionID) AS r FROM {TXN_EVENTS})
    WHERE r = 1 AND TransactionAmount >= 50""")
def pat_new_account(spark, folder):
    return P.large_first(txn_events(spark, folder), at_least=50)


@query("pat_session", f"""
    SELECT TransactionID, LoginAttempts, TransactionDuration FROM {TXN_EVENTS} WHERE LoginAttempts >= 90 OR TransactionDuration >= 380""")
def pat_session(spark, folder):
    found = P.session_extremes(txn_events(spark, folder), logins=90, duration=380)
    return found.select("TransactionID", "LoginAttempts", "TransactionDuration")


@query("pat_cross_border", f"""
    SELECT TransactionID, Location, TransactionAmount FROM {TXN_EVENTS} WHERE Location IN ('signup', 'error') AND TransactionAmount >= 200""")
def pat_cross_border(spark, folder):
    found = P.cross_border(txn_events(spark, folder), ["signup", "error"], 200)
    return found.select("TransactionID", "Location", "TransactionAmount")


@query("pat_takeover", f"""
    SELECT TransactionID, CustomerID, tiny_before FROM (
        SELECT *, COUNT(*) FILTER (WHERE TransactionAmount <= 5) OVER (PARTITION BY CustomerID ORDER BY epoch_us(TransactionDate)
               RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tiny_before FROM {TXN_EVENTS})
    WHERE TransactionAmount >= 100 AND tiny_before >= 2""")
def pat_takeover(spark, folder):
    return P.takeovers(txn_events(spark, folder), tiny=5, large=100).select("TransactionID", "CustomerID", "tiny_before")


@query("pat_customer_z", f"""
    SELECT TransactionID, CustomerID, round(z, 5) AS customer_z FROM (
        SELECT *, (TransactionAmount - AVG(TransactionAmount) OVER w) / nullif(STDDEV_SAMP(TransactionAmount) OVER w, 0) AS z
        FROM {TXN_EVENTS} WINDOW w AS (PARTITION BY CustomerID)) WHERE abs(z) > 2""")
def pat_customer_z(spark, folder):
    found = P.customer_deviations(txn_events(spark, folder))
    return found.select("TransactionID", "CustomerID", F.round("customer_z", 5).alias("customer_z"))
