import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertlake.functions import scalars as S


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


TIES = [0.125, 2.675, 1.005, 0.375, -0.125, -2.675, 0.005, 1.115, 1.125, 2.5, 1234567.885, 0.0, 99.995, 1e15 + 0.5, 10.235, 1e-9]


def test_fixed_decimals_match_python(spark):
    rng = random.Random(1)
    values = TIES + [rng.randrange(10**7) / 1000 for _ in range(2000)] + [rng.random() * 1e6 for _ in range(200)]
    assert column(spark, values, S.format_fixed) == [f"{v:.2f}" for v in values]
    assert column(spark, values, lambda c: S.format_fixed(c, 4)) == [f"{v:.4f}" for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-10**9, 10**9), min_size=50, max_size=200))
def test_fixed_decimals_any_thousandth(spark, whole):
    values = [w / 1000 for w in whole]
    assert [v.replace("-0.00", "0.00") if v == "-0.00" else v for v in column(spark, values, S.format_fixed)] == [
        f"{v:.2f}".replace("-0.00", "0.00") if f"{v:.2f}" == "-0.00" else f"{v:.2f}" for v in values]


def test_flags(spark):
    texts = ["true", "TRUE", "True", "false", "1", "0", None, "yes", " true"]
    assert column(spark, texts, S.is_true, "string") == [True, True, True, False, False, False, False, False, False]
    assert column(spark, texts, S.flag_to_boolean, "string") == [True, True, True, False, True, False, False, False, True]
    assert column(spark, [True, False, None], S.is_true, "boolean") == [True, False, False]


def test_times(spark):
    texts = ["2024-05-01 10:20:30", "2024-05-01", "rubbish", "", None]
    parsed = column(spark, texts, S.parse_time, "string")
    assert [str(p) for p in parsed] == ["2024-05-01 10:20:30", "2024-05-01 00:00:00", "None", "None", "None"]
    night = column(spark, texts, lambda c: S.hour_in(S.parse_time(c), 0, 5), "string")
    assert night == [False, True, None, None, None]


def test_elapsed_days_are_not_calendar_days(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 23:00:00' a, timestamp_ntz '2024-01-02 01:00:00' b")
    row = df.select(S.elapsed_days(F.col("a"), F.col("b")).alias("d"), S.elapsed_days(F.col("b"), F.col("a")).alias("e")).first()
    assert (row["d"], row["e"]) == (0, -1)


def test_nan_is_missing(spark):
    assert column(spark, [1.0, float("nan"), None], lambda c: S.no_nan(c) > 0) == [True, None, None]


def test_next_version(spark):
    versions = ["v0.0.0", "v1.0.0", "v22.3.1", "v2", "draft", "v1.2.x"]
    assert column(spark, versions, lambda c: S.next_version(c, F.lit("20240101")), "string") == [
        "v1.0.0", "v2.0.0", "v23.0.0", "v20240101", "v20240101", "v20240101"]


def test_report_labels(spark):
    df = spark.createDataFrame([(1, -20.0, 30, 92.0, 0), (2, -19.9, 31, 91.9, 1), (3, None, 0, None, 0), (4, 5.0, 10, 99.0, 0)],
                               "i int, change double, complaints int, uptime double, flags int")
    got = [r["s"] for r in df.select("i", S.report_label(*[F.col(c) for c in df.columns[1:]]).alias("s")).orderBy("i").collect()]
    assert got == ["Significant revenue drop", "Spike in customer complaints; ATM downtime increased; Potential fraud detected",
                   "No significant issues", "No significant issues"]


def test_age_groups(spark):
    assert column(spark, [17, 18, 24, 25, 44, 64, 65, 90, None], S.age_group, "int") == [
        None, "18-24", "18-24", "25-34", "35-44", "55-64", "65+", "65+", None]
