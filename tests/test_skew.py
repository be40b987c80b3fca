"""Sliced windows must equal windows over the whole key, also for a key that owns most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alertlake.operators import detectors as D
from alertlake.operators import patterns as P
from alertlake.operators.skew import DAY, HOUR, number_rows, with_previous


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 3, 1)
    data = []
    for i in range(4000):
        customer = "hot" if rng.random() < 0.4 else f"c{rng.randrange(40)}"
        when = start + dt.timedelta(seconds=rng.randrange(20 * 86400)) if rng.random() < 0.9 else start + dt.timedelta(hours=rng.randrange(480))
        data.append((f"t{i:05d}", i, customer, when, float(rng.randrange(1, 12000)), rng.choice("ABC")))
    data += [("n1", 5001, None, start, 1.0, "A"), ("n2", 5002, "c1", None, 1.0, "A")]
    return spark.createDataFrame(
        data, "TransactionID string, n int, CustomerID string, TransactionDate timestamp_ntz, TransactionAmount double, Location string").cache()


def whole(rows):
    return Window.partitionBy("CustomerID").orderBy("TransactionDate", "TransactionID")


def ids(df):
    return sorted(r["TransactionID"] for r in df.select("TransactionID").collect())


def keyed(rows):
    return rows.where("CustomerID is not null and TransactionDate is not null")


def test_rapid_rows(rows):
    gap = F.timestamp_diff("MICROSECOND", F.lag("TransactionDate").over(whole(rows)), F.col("TransactionDate"))
    want = keyed(rows).withColumn("g", gap).where(F.col("g") < 5 * 60e6)
    assert ids(D.rapid_rows(rows)) == ids(want) != []


def test_bursts(rows):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', TransactionDate)")
    frame = Window.partitionBy("CustomerID").orderBy(us).rangeBetween(-20 * 60 * 10**6, 0)
    want = keyed(rows).withColumn("k", F.count(F.lit(1)).over(frame)).where("k >= 3")
    assert ids(P.bursts(rows, 3, 20)) == ids(want) != []


def test_takeovers(rows):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', TransactionDate)")
    frame = Window.partitionBy("CustomerID").orderBy(us).rangeBetween(-24 * HOUR, -1)
    tiny = F.count_if(F.col("TransactionAmount") <= 300).over(frame)
    want = keyed(rows).withColumn("k", tiny).where("TransactionAmount >= 8000 and k >= 2")
    assert ids(P.takeovers(rows, tiny=300)) == ids(want) != []


def test_location_jumps(rows):
    w = whole(rows)
    want = keyed(rows).withColumn("p", F.lag("Location").over(w)).withColumn("g", F.timestamp_diff(
        "MICROSECOND", F.lag("TransactionDate").over(w), F.col("TransactionDate"))).where((F.col("p") != F.col("Location")) & (F.col("g") <= HOUR))
    assert ids(P.location_jumps(rows, 1)) == ids(want) != []


@pytest.mark.parametrize("width", [HOUR, DAY, 400 * DAY])
def test_with_previous(rows, width):
    take = {"before": "TransactionDate", "where_before": "Location"}
    got = with_previous(rows, "CustomerID", "TransactionDate", "TransactionID", take, width)
    want = keyed(rows).withColumn("before", F.lag("TransactionDate").over(whole(rows))).withColumn(
        "where_before", F.lag("Location").over(whole(rows)))
    columns = ["TransactionID", "before", "where_before"]
    assert sorted(map(str, got.where("CustomerID is not null and TransactionDate is not null").select(columns).collect())) == sorted(
        map(str, want.select(columns).collect()))
    assert got.count() == rows.count()
    dropped = with_previous(rows, "CustomerID", "TransactionDate", "TransactionID", take, width, keep_unkeyed=False)
    assert dropped.count() == rows.count() - 2


def test_number_rows(spark, rows):
    got = number_rows(rows, "n", "k", ranges=7).select("n", "k").orderBy("n").collect()
    assert [r["k"] for r in got] == list(range(1, rows.count() + 1))
    same = spark.createDataFrame([(1.0,)], "n double")
    assert number_rows(same, "n", "k").first()["k"] == 1


def test_hot_customer_is_spread(rows):
    """The busiest customer's rows must reach several tasks, none of which holds most of them."""
    from alertlake.operators.skew import MINUTE, sliced_with_reach

    hot = rows.where("CustomerID = 'hot'")
    sliced = sliced_with_reach(hot, "TransactionDate", 5 * MINUTE).repartition(8, "CustomerID", "_slice")
    sizes = [r["count"] for r in sliced.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)
    assert sum(sizes) < 1.2 * hot.count()  # copies for the neighbouring slice are few


def test_ranks_are_limited_before_the_shuffle(rows):
    rules = D.row_rules(rows, D.Limits(amount_quantile=0.5))
    sampled = D.with_samples(D.count_rules(rows, rules), D.tagged_rows(rows, rules), ["TransactionID"], "TransactionID")
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    before, after = plan.rsplit("Exchange hashpartitioning(anomaly_type", 1)
    assert "WindowGroupLimit" in after and "Partial" in after
