"""Investigations by id over a sorted snapshot: the same tags as over all rows, and scans that are told what to leave out."""

import re

import pytest
from pyspark.sql import functions as F

from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.operators import investigation as I
from alertlake.plans.trend_queries import found_patterns, looks
from alertlake.plans.views import txn_events
from alertlake.workspace import new_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return txn_events(spark, FOLDER)


@pytest.fixture(scope="module")
def snapshot(spark, events):
    extra = events.limit(1).select(*[F.lit(None).cast(t).alias(c) if c in ("CustomerID", "TransactionDate") else
                                     F.lit("nobody").alias(c) if c == "TransactionID" else F.col(c) for c, t in events.dtypes])
    return I.write_snapshot(events.unionByName(extra.withColumn("LoginAttempts", F.lit(50))), new_folder(spark, "test-snapshot"))


def broken(df):
    return {r["TransactionID"]: list(r["broken_rules"]) for r in df.collect()}


def test_same_tags_as_over_all_rows(spark, events, snapshot):
    tagged = [D.tagged_rows(events, D.row_rules(events)), D.rapid_rows(events).withColumn("anomaly_type", F.lit("velocity_anomaly")),
              A.pattern_tags(events, found_patterns(events))]
    everything = broken(A.investigate(events, tagged, events.select("TransactionID")))
    ids = sorted(everything, key=lambda i: (-len(everything[i]), i))
    for asked in (ids[:3], ids[:80], ids[-2:], [r["TransactionID"] for r in D.rapid_rows(events).collect()]):
        assert broken(I.investigate_ids(spark, snapshot, asked, looks())) == {i: everything[i] for i in asked}


def test_unknown_repeated_and_incomplete_rows(spark, snapshot):
    assert broken(I.investigate_ids(spark, snapshot, ["none"], looks())) == {}
    assert broken(I.investigate_ids(spark, snapshot, [], looks())) == {}
    found = broken(I.investigate_ids(spark, snapshot, ["nobody", "nobody"], looks()))
    assert list(found) == ["nobody"] and "high_login_attempts" in found["nobody"] and "velocity_anomaly" not in found["nobody"]
    with pytest.raises(ValueError):
        I.investigate_ids(spark, snapshot, [str(i) for i in range(I.MOST_IDS + 1)], looks())


def test_every_scan_is_filtered(spark, events, snapshot):
    asked = [r[0] for r in events.select("TransactionID").orderBy("TransactionID").limit(2).collect()]
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = I.investigate_ids(spark, snapshot, asked, looks())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "FileScan" in line and "TransactionID" in line]
    assert len(scans) > 8
    for line in scans:
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", line)[1]
        assert "CustomerID" in pushed or "TransactionID" in pushed, line
    timed = [line for line in scans if "LessThanOrEqual(TransactionDate" in line or "TransactionDate,20" in line]
    assert timed  # rules that look back a bounded time are told the range
