import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.operators import drift as M
from alertlake.workspace import new_folder

NOW = "2024-02-01 00:00:00"


def log(spark, pairs, name="response_time_seconds"):
    rows = [(dt.datetime(2024, 2, 1) - dt.timedelta(days=d), float(v)) for d, v in pairs]
    return spark.createDataFrame(rows, f"timestamp timestamp_ntz, {name} double")


@pytest.mark.parametrize("pairs, detected, reason, change", [
    ([(20, 10), (10, 10), (3, 12)], False, None, 20.0),  # exactly the threshold is no drift
    ([(20, 10), (3, 12.1)], True, None, 21.0),
    ([(20, 10), (3, 5)], True, None, -50.0),
    ([(40, 1), (20, 10), (7, 10), (3, 10)], False, None, 0.0),  # older than the baseline is ignored, seven days ago is current
    ([(20, 10)], False, "Insufficient data", None),
    ([], False, "No data available", None),
])
def test_response_time(spark, pairs, detected, reason, change):
    row = M.response_time_drift(log(spark, pairs), NOW).first()
    assert (row["drift_detected"], row["reason"]) == (detected, reason)
    assert row["percent_change"] == (pytest.approx(change) if change is not None else None)


def test_feedback_only_falls_count(spark):
    rise, fall = [(20, 2), (3, 5)], [(20, 5), (3, 4)]
    assert M.feedback_drift(log(spark, rise, "alert_quality"), NOW).first()["drift_detected"] is False
    assert M.feedback_drift(log(spark, fall, "alert_quality"), NOW).first()["drift_detected"] is True


def test_recent_includes_the_edge(spark):
    assert M.recent(log(spark, [(7, 1), (7.01, 1), (1, 1)]), NOW).count() == 2


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.RandomState(4)
    vectors = [rng.randn(50, 6) + 1.0, rng.randn(40, 6) * [3, 1, 1, 1, 1, 1] + 0.5]
    frames = [spark.createDataFrame([(i + 100 * s, [float(x) for x in v]) for i, v in enumerate(side)], "id int, embedding array<double>")
              for s, side in enumerate(vectors)]
    return vectors, frames


def test_embeddings(sides):
    vectors, frames = sides
    a, b = vectors[0].mean(axis=0), vectors[1].mean(axis=0)
    row = M.embedding_drift(*frames).first()
    assert row["distance"] == pytest.approx(1 - a @ b / np.sqrt((a @ a) * (b @ b)))
    none = M.embedding_drift(frames[0], frames[1].where(F.lit(False))).first()
    assert (none["drift_detected"], none["reason"], none["distance"]) == (False, "Insufficient data", None)


def test_plane_matches_numpy(sides):
    vectors, frames = sides
    rows = M.plane(*frames).orderBy("id").collect()
    stacked = np.vstack(vectors)
    values, axes = np.linalg.eigh(np.cov(stacked.T))
    order = np.argsort(-values)[:2]
    want = stacked @ axes[:, order]
    got = np.array([[r["x"], r["y"]] for r in rows])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert rows[0]["x_share"] == pytest.approx(values[order[0]] / values.sum())


def test_all_checks_and_samples(spark, sides):
    _, frames = sides
    checks = M.all_checks(log(spark, [(20, 10), (3, 30)]), log(spark, [(20, 4), (3, 4)], "alert_quality"), None, None, NOW).collect()
    assert [c["metric"] for c in checks] == ["response_time_seconds", "alert_quality"] and all(c["any_drift_detected"] for c in checks)
    path = new_folder(spark, "test-samples")
    M.save_sample(frames[0], path, "2024-01-01", 10)
    M.save_sample(frames[1], path, "2024-01-02", 10)
    latest = M.load_sample(spark, path)
    assert latest.count() == 10 and latest.agg(F.min("id")).first()[0] >= 100
    assert sorted(r["id"] for r in M.sample(frames[0], 7).collect()) == sorted(r["id"] for r in M.sample(frames[0].repartition(5), 7).collect())


def test_a_repeated_sample_replaces_itself(spark):
    path = new_folder(spark, "test-sample")
    rows = spark.range(100)
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        M.save_sample(rows, path, day, 10)
    assert M.load_sample(spark, path).count() == 10 and spark.read.parquet(path).count() == 20
