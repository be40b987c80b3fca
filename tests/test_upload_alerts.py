"""The rows behind an upload's alerts, and what an upload costs."""

import random

import pytest
from pyspark.sql import functions as F

from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.plans import jobs
from alertlake.workspace import new_folder

SCHEMA = "TransactionID string, CustomerID string, TransactionDate timestamp_ntz, TransactionAmount double, Location string, LoginAttempts int"


def made(spark, number=300):
    rng = random.Random(3)
    rows = [(None if i == 7 else f"t{i:04d}", rng.choice(["a", "b", None]), f"2024-01-0{rng.randint(1, 3)} 0{rng.randint(0, 9)}:{rng.randint(10, 59)}:00",
             rng.choice([None, float("nan"), 1.0 * i]), rng.choice(["N", "S", "W", "E", None]), rng.choice([None, 1, 9])) for i in range(number)]
    text = SCHEMA.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, text).withColumn("TransactionDate", F.to_timestamp_ntz("TransactionDate"))


def wanted(df):
    """{type: (first ids, places)} by brute force, but for the rules' own conditions."""
    rules = D.row_rules(df)
    out = {}
    for kind, rows in D.anomaly_rows(df, rules).items():
        found = [(r["TransactionID"], r["Location"]) for r in rows.collect()]
        ids = sorted((i for i, _ in found), key=lambda i: (i is not None, i or ""))[:5]
        places = sorted({p for _, p in found if p is not None})
        if found:
            out[kind] = ids, " at " + ", ".join(places) if places else None
    return out


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_and_places_are_those_of_all_rows(spark):
    df = made(spark)
    got = {r["anomaly_type"]: ([x["TransactionID"] for x in r["related"]], r["location_info"]) for r in A.related_rows(df).collect()}
    assert got == wanted(df)
    assert set(got) == {"large_transactions", "high_login_attempts", "overnight_transactions", "velocity_anomaly", "location_insights"}


def test_first_rows_are_taken_before_they_are_ranked(spark):
    """Each type's rows pass a limit of their own, so that the window over types sorts no more than these."""
    plan = plan_of(A.related_rows(made(spark).drop("CustomerID")))
    above, _, below = plan.partition("Window [row_number()")
    assert below.count("GlobalLimit 5") >= 4 and "WindowGroupLimit" not in plan


@pytest.mark.parametrize("columns", [["TransactionID"], ["TransactionID", "Location"], ["TransactionID", "TransactionAmount"]])
def test_few_columns(spark, columns):
    found = A.related_rows(made(spark).select(*columns)).collect()
    assert {r["anomaly_type"] for r in found} == ({"location_insights"} if "Location" in columns else set()) | (
        {"large_transactions"} if "TransactionAmount" in columns else set())


def test_the_limit_of_an_upload_is_found_once(spark, monkeypatch):
    calls, real = [], D.quantiles
    monkeypatch.setattr(D, "quantiles", lambda *a, **b: calls.append(1) or real(*a, **b))
    kinds = {r["type"] for r in jobs.upload_alerts(made(spark), "20240101000000").collect()}
    assert len(calls) == 1 and {"general_insight", "large_transactions"} <= kinds


def test_keys_are_reduced_only_for_few_rows(spark):
    folder = new_folder(spark, "test-few")
    rows = made(spark, 100)
    jobs.ingest(None, rows.limit(60), folder, "v1.0.0", "1")
    parts = jobs.version_parts(spark, folder, "v1.0.0")
    keyed = jobs.row_keys(rows)
    few, many = jobs.unknown_rows(keyed, parts, 1), jobs.unknown_rows(keyed, parts, 100)
    assert "LeftSemi" in plan_of(few) and "LeftSemi" not in plan_of(many)
    ids = [sorted(str(r["TransactionID"]) for r in df.collect()) for df in (few, many)]
    assert ids[0] == ids[1]


def test_both_versions_of_sparse_orders_take_one_join(spark, monkeypatch, tmp_path):
    from alertlake.plans import version_queries as Q

    orders = [(k, 1, "F", 10.0 * i, f"1998-0{1 + i % 9}-01", p) for i, (k, p) in enumerate([(1, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "c"), (4, None), (None, "a")])]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string") \
        .withColumn("o_orderdate", F.to_timestamp_ntz("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "C", 1, 5.0, "s")], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    given, real = [], jobs.ingest
    monkeypatch.setattr(jobs, "ingest", lambda old, new, *a, **b: given.append(new) or real(old, new, *a, **b))
    got = {r["value"]: (r["described"], r["on_device"]) for r in Q.ingest_sparse(spark, str(tmp_path)).collect()}
    # Order 2 comes twice at two prices and meets both of its priorities, which are one; order 3 meets two.
    assert got == {"a": (3, 3), "b": (2, 2), "c": (2, 2), None: (0, 0)}
    assert len(given) == 2 and not any("Join" in plan_of(new) for new in given)
