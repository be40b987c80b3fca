import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertlake.operators.quantiles import approximate_quantiles, quantiles
from alertlake.operators.sizing import input_bytes

PROBS = {"a": ("x", 0.0), "b": ("x", 0.05), "c": ("x", 0.5), "d": ("x", 0.95), "e": ("x", 0.99), "f": ("x", 1.0)}


def both(df):
    return tuple(df.agg(*[F.percentile(c, p).alias(a) for a, (c, p) in PROBS.items()]).first()), tuple(quantiles(df, PROBS).first())


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [0.0, 0.0, 0.0], [-3.5, 0.0, 7.25, 7.25, 1e300, -1e-300, 4.0], list(np.random.RandomState(1).lognormal(3, 4, 5000)),
    list(-np.random.RandomState(2).rand(3000)), [1.0 + i * 2.0 ** -52 for i in range(500)], [3.0] * 4000 + [9.0],
])
def test_narrowed_equals_percentile_and_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    small, narrowed = both(df)
    assert narrowed == small
    assert np.allclose(narrowed, [np.quantile(values, p) for _, p in PROBS.values()], rtol=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_any_values(spark, values):
    small, narrowed = both(spark.createDataFrame([(float(v),) for v in values], "x double"))
    assert narrowed == small


def test_missing_values_and_several_columns(spark):
    df = spark.createDataFrame([(1.0, 10), (float("nan"), 20), (None, None), (3.0, 30)], "x double, y int")
    row = quantiles(df, {"x": ("x", 0.5), "y": ("y", 0.5)}).first()
    assert (row["x"], row["y"]) == (2.0, 20.0)
    empty = df.where(F.lit(False))
    assert quantiles(empty, {"x": ("x", 0.5)}).first()["x"] is None


def test_approximate(spark):
    df = spark.range(100000).select(F.col("id").cast("double").alias("x"))
    assert abs(approximate_quantiles(df, {"m": ("x", 0.5)}).first()["m"] - 50000) < 50


def test_size_check(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert 0 < input_bytes(events) < 1_000_000
