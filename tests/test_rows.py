"""Cleaning, features, summaries and detectors on small literal frames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from alertlake.operators import alerts as A
from alertlake.operators import clean as C
from alertlake.operators import detectors as D
from alertlake.operators import features as X
from alertlake.operators import patterns as P
from alertlake.operators import summary as S
from alertlake.schema import pick

NAMES = ("TransactionID string, AccountID string, TransactionAmount double, TransactionDate string, TransactionType string, Location string, "
         "`IP Address` string, CustomerAge int, LoginAttempts int, TransactionDuration int, PreviousTransactionDate string")


@pytest.fixture(scope="module")
def three(spark):
    return spark.createDataFrame([
        ("TX1", "A1", 100.0, "2023-01-01 10:00:00", "Debit", "New York", "1.1.1.1", 25, 1, 60, "2022-12-31 09:00:00"),
        ("TX2", "A2", 200.0, "2023-01-02 11:00:00", "Credit", "Chicago", "2.2.2.2", 35, 2, 120, "2022-12-31 10:00:00"),
        ("TX3", "A3", 300.0, "2023-01-03 12:00:00", "Debit", "New York", "3.3.3.3", 45, 1, 180, "2022-12-31 11:00:00"),
    ], NAMES)


def found(df):
    return {r["type"]: r for r in df.collect()}


def test_clean_keeps_rows_and_parses_dates(three):
    out = C.clean(three)
    assert dict(out.dtypes)["TransactionDate"] == dict(out.dtypes)["PreviousTransactionDate"] == "timestamp_ntz"
    assert out.count() == 3
    assert C.clean(three.union(three)).count() == 3


def test_features(three):
    out = X.create_features(C.clean(three)).orderBy("TransactionID").collect()
    assert {"TransactionDay", "TransactionMonth", "TransactionYear", "TransactionDayOfWeek", "IsWeekend", "DaysSincePreviousTx",
            "IsLargeTransaction", "IsCredit", "AgeGroup"} <= set(out[0].asDict())
    assert [r["IsCredit"] for r in out] == [0, 1, 0]
    assert [r["TransactionDayOfWeek"] for r in out] == [6, 0, 1]  # Monday is 0
    assert [r["IsWeekend"] for r in out] == [1, 0, 0]
    assert [r["DaysSincePreviousTx"] for r in out] == [1, 2, 3]
    assert [r["IsLargeTransaction"] for r in out] == [0, 0, 1]
    assert [r["AgeGroup"] for r in out] == ["25-34", "35-44", "45-54"]


def test_features_skip_missing_columns(spark):
    out = X.create_features(spark.createDataFrame([("a", 1)], "TransactionID string, n int"))
    assert out.columns == ["TransactionID", "n"]


def test_both_summary_grains(three):
    rows = X.create_features(C.clean(three))
    assert S.daily_summaries(rows).where("Location = 'New York'").count() == 2
    levels = S.summary_levels(rows).where("Level = 'branch' and Location = 'New York'").first()
    assert levels["TransactionCount"] == 2 and levels["TotalAmount"] == 400.0
    assert S.summary_levels(rows).where("Level = 'all'").first()["TransactionCount"] == 3
    one = S.daily_summaries(rows).first()
    assert one["AmountStdDev"] is None and one["AverageCustomerAge"] is not None


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (float("nan"), 5.0)], "x double, same double")
    out = C.standardise(df, ["x", "same"]).collect()
    assert out[0]["x"] == pytest.approx(-math.sqrt(1.5)) and out[3]["x"] is None and out[0]["same"] == 0.0


def test_backfills(spark):
    df = spark.createDataFrame([(3, 0.9), (1, 0.7), (2, None)], "n int, FraudRiskScore double")
    out = C.backfill_fraud_flag(C.backfill_ids(df, "n")).orderBy("n").collect()
    assert [r["TransactionID"] for r in out] == ["TX001000", "TX001001", "TX001002"]
    assert [r["FraudFlag"] for r in out] == [False, False, True]
    assert C.backfill_fraud_flag(df.select("n")).first()["FraudFlag"] is False
    assert C.backfill_ids(df.withColumn("TransactionID", F.lit("x")), "n").first()["TransactionID"] == "x"
    long = C.backfill_ids(spark.range(1).withColumnRenamed("id", "n"), "n", first=12345678).first()["TransactionID"]
    assert long == "TX12345678"


def test_velocity_is_strict_and_ignores_missing_customers(spark):
    base = dt.datetime(2024, 5, 15, 14)
    rows = [("a", "c", base), ("b", "c", base + dt.timedelta(minutes=5)), ("d", "c", base + dt.timedelta(minutes=9, seconds=59)),
            ("e", None, base), ("f", None, base), ("g", "x", base), ("h", "x", base)]
    df = spark.createDataFrame(rows, "TransactionID string, CustomerID string, TransactionDate timestamp_ntz")
    assert sorted(r["TransactionID"] for r in D.rapid_rows(df).collect()) == ["d", "h"]
    assert found(D.velocity(df))["velocity_anomaly"]["details"] == "Found 2 transactions occurring in rapid succession (<5 min apart)"


def test_date_only_rows_count_as_night_and_text_dates_work(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01 05:00:00"), ("c", "junk"), ("d", None)], "TransactionID string, Date string")
    assert found(D.detect_upload(df))["overnight_transactions"]["count"] == 1


def test_nan_amount_is_not_large(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("nan"),)], "TransactionAmount double")
    assert found(D.detect_upload(df))["large_transactions"]["count"] == 5


def test_location_ties_go_by_name(spark):
    df = spark.createDataFrame([(c,) for c in "DDCCBBAAE"] + [(None,)], "Location string")
    row = found(D.detect_upload(df))["location_insights"]
    assert row["top_locations"] == ["A", "B", "C"] and row["count"] == 6
    assert row["location_distribution"] == {"A": 2, "B": 2, "C": 2, "D": 2, "E": 1}


def test_overview_only_when_nothing_else(spark):
    quiet = spark.createDataFrame([("t1", 5.0), ("t2", 5.0)], "TransactionID string, TransactionAmount double")
    rows = found(D.detect_upload(quiet))
    assert list(rows) == ["transactions_overview"]
    assert rows["transactions_overview"]["details"] == "Analyzed 2 transactions with average amount 5.00"
    assert rows["transactions_overview"]["sample"] == [{"TransactionID": "t1"}, {"TransactionID": "t2"}]
    assert "transactions_overview" not in found(D.detect_upload(quiet.withColumn("FraudFlag", F.lit("TRUE"))))
    assert D.detect_upload(quiet.where(F.lit(False))).count() == 0


def test_volume_takes_first_day_and_single_day_branches_pass(spark):
    days = [("A", f"2024-01-{d:02d}", 10) for d in range(1, 20)] + [("A", "2024-01-20", 90), ("A", "2024-01-21", 95), ("B", "2024-01-01", 7), (None, "2024-01-01", 99)]
    df = spark.createDataFrame(days, "Location string, Date string, TransactionCount bigint")
    rows = D.unusual_volume(df).collect()
    assert [(r["entity"], r["event_date"], r["actual_count"]) for r in rows] == [("A", "2024-01-20", 90)]
    assert rows[0]["expected_count"] == (19 * 10 + 90 + 95) // 21


def test_other_datasets(spark):
    df = spark.createDataFrame([(i, i % 10 == 0, 1 if i % 4 == 0 else 0, "x", 1000.0 if i < 3 else float(i % 7), float(i)) for i in range(100)],
                               "case_id int, is_flagged boolean, alert_level int, alert_text string, size double, residual double")
    rows = found(D.detect_datasets({"cases": df}))
    assert rows["cases_is_flagged"]["count"] == 10 and rows["cases_alert_level"]["count"] == 25
    assert rows["cases_size_extreme_high"]["count"] == 3
    assert not any("residual" in t or "case_id" in t or "alert_text" in t for t in rows)
    assert D.numeric_columns(df) == ["case_id", "alert_level", "size", "residual"]


def test_batch_sample_prefers_branch_id(spark):
    df = spark.createDataFrame([(f"t{i:03d}", float(i), "Debit", "b", "l") for i in range(200)],
                               "TransactionID string, TransactionAmount double, TransactionType string, BranchID string, Location string")
    assert pick(df, "BranchID", "Location") == "BranchID"
    row = found(D.detect_datasets({"transactions": df}))["large_transactions"]
    assert row["count"] == 2 and set(row["sample"][0]) == {"TransactionID", "TransactionAmount", "TransactionType", "BranchID"}


def test_own_detector(spark):
    df = spark.createDataFrame([("a", "L")], "TransactionID string, Location string")
    D.register_detector("always", lambda rows: rows.agg(F.lit("mine").alias("type"), F.lit("low").alias("severity"), F.count("*").alias("count")))
    try:
        assert "mine" in found(D.detect_upload(df))
    finally:
        D._REGISTRY.clear()


def test_patterns_hit_exactly_the_planted_rows(spark):
    day = dt.datetime(2024, 5, 10)

    def at(d, h, m=0):
        return day + dt.timedelta(days=d, hours=h, minutes=m)

    rows = []

    def add(customer, when, amount=100.0, place="Chicago", logins=1, duration=60):
        rows.append((f"P{len(rows):03d}", customer, when, amount, place, logins, duration))
        return rows[-1][0]

    for i in range(3):
        add("night", at(i, 1 + i))
    burst = [add("burst", at(5, 14, 5 * i), 60.0 + i) for i in range(4)]
    for i in range(5):
        add("near", at(6 + i, 10), 9750.0 + 40 * i)
    for i in range(3):
        add("round", at(10 + i, 16), 1000.0 * (i + 1))
    moves = [add("mover", at(12, 6 * i), place=p) for i, p in enumerate(["New York", "Los Angeles", "Miami"])]
    for i in range(3):
        add(f"new{i}", at(13 + i, 9), 15000.5 + i)
    long = [add("session", at(14, 5 + i), logins=30 + i, duration=300 + i) for i in range(3)]
    abroad = [add("abroad", at(15, 6 + i), 50000.5 + i, p) for i, p in enumerate(["Dubai", "Zürich", "Moscow"])]
    add("taken", at(16, 12), 2.0)
    add("taken", at(16, 14), 3.0)
    last = add("taken", at(16, 16), 9000.5)
    for i in range(40):
        add(f"calm{i}", at(20, 9 + i % 10), 55.5 + i)
    df = spark.createDataFrame(rows, "TransactionID string, CustomerID string, TransactionDate timestamp_ntz, TransactionAmount double, "
                                     "Location string, LoginAttempts int, TransactionDuration int")

    def tx(out):
        return sorted(r["TransactionID"] for r in out.collect())

    def customers(out):
        return sorted(r["CustomerID"] for r in out.collect())

    assert customers(P.night_activity(df)) == ["night"]
    assert tx(P.bursts(df)) == [burst[-1]]
    assert customers(P.structuring(df)) == ["near"]
    assert customers(P.round_amounts(df)) == ["round"]
    assert tx(P.location_jumps(df)) == sorted(moves[1:] + abroad[1:])
    assert customers(P.large_first(df)) == ["abroad", "new0", "new1", "new2"]
    assert tx(P.session_extremes(df)) == long
    assert tx(P.cross_border(df, ["Dubai", "Moscow", "Cayman Islands", "Zürich", "Hong Kong"])) == abroad
    assert tx(P.takeovers(df)) == [last]
    assert tx(P.customer_deviations(df)) == []
    spread = df.unionByName(df.withColumns({"CustomerID": F.lit("calm"), "TransactionAmount": F.lit(10.0), "TransactionID": F.concat(F.lit("x"), "TransactionID")}))
    one = spark.createDataFrame([("odd", "calm", day, 500.0, "Chicago", 1, 1)], df.schema)
    assert tx(P.customer_deviations(spread.unionByName(one))) == ["odd"]


def test_alert_order_and_defaults(spark):
    df = spark.createDataFrame([("1", "low", "a", dt.datetime(2024, 1, 1)), ("2", "odd", "a", dt.datetime(2024, 1, 1)), ("3", "high", "a", dt.datetime(2024, 1, 2)),
                                ("4", "high", "a", None), ("5", None, "a", dt.datetime(2023, 1, 1)), ("6", "medium", "a", dt.datetime(2024, 1, 1))],
                               "id string, severity string, type string, timestamp timestamp_ntz")
    assert [r["id"] for r in A.ranked(df).collect()] == ["4", "3", "6", "5", "1", "2"]


def test_responses(spark):
    df = spark.createDataFrame([(1, '{"title": "T", "description": "D", "recommended_actions": ["x", "y"]}'), (2, "\n  \nFirst line\nrest"), (3, "   "),
                                (4, '{"broken": '), (5, '{"title": "only"}'), (6, "x" * 150)], "i int, response string")
    rows = {r["i"]: r for r in A.parse_responses(df).collect()}
    assert (rows[1]["title"], rows[1]["recommended_actions"]) == ("T", ["x", "y"])
    assert rows[2]["title"] == "First line" and rows[2]["description"] == "\n  \nFirst line\nrest"
    assert rows[3]["title"] == "Alert Generated" and rows[4]["title"].startswith('{"broken"')
    assert len(rows[4]["recommended_actions"]) == 3 and rows[5]["title"] == "only" and rows[5]["description"] is None
    assert len(rows[6]["title"]) == 100


def test_batch_rules_on_standardised_values(spark):
    df = spark.createDataFrame([(f"t{i:03d}", float(i), 1) for i in range(99)] + [("odd", 5.0, 9)],
                               "TransactionID string, TransactionAmount double, LoginAttempts int")
    raw = found(D.detect_datasets({"transactions": df}))
    scaled = found(D.detect_datasets({"transactions": df}, on="zscore"))
    assert raw["high_login_attempts"]["count"] == scaled["high_login_attempts"]["count"] == 1
    assert scaled["large_transactions"]["threshold"] < 3 < raw["large_transactions"]["threshold"]
    with pytest.raises(ValueError):
        D.detect_datasets({"transactions": df}, on="other")


def test_rule_options(spark):
    df = spark.createDataFrame([(float(i), dt.datetime(2024, 1, 1, i % 2, 0)) for i in range(1000)],
                               "TransactionAmount double, TransactionDate timestamp_ntz")
    rows = found(D.count_rules(df, D.row_rules(df, D.Limits(require_time=True, exact_quantile=False))))
    assert rows["overnight_transactions"]["count"] == 500
    assert abs(rows["large_transactions"]["count"] - 50) <= 1
