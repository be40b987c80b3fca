"""Summaries and limits of a growing history against those of all its rows."""

import random

import pytest
from pyspark.sql import functions as F

from alertlake.operators import history as H
from alertlake.operators.features import LARGE_QUANTILE
from alertlake.operators.quantiles import quantiles
from alertlake.operators.summary import daily_summaries
from alertlake.plans import jobs
from alertlake.workspace import new_folder

SCHEMA = "TransactionID string, TransactionDate string, TransactionAmount double, Location string, LoginAttempts int, TransactionType string"


def made(spark, number, first, scale=1.0, seed=0):
    rng = random.Random(seed)
    rows = [(f"t{first + i}", f"2024-01-{rng.randint(1, 9):02d} 10:00:00", None if rng.random() < 0.05 else scale * rng.lognormvariate(3, 1),
             rng.choice(["N", "S", None]), rng.choice([None, 1, 2, 9]), rng.choice(["Credit", "Debit"])) for i in range(number)]
    return spark.createDataFrame(rows, SCHEMA)


def rounded(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def check(done):
    """An ingest's summaries are those of all its rows, columns and all, and its limit is their quantile."""
    want = daily_summaries(done.transactions)
    assert done.summaries.columns == want.columns
    assert rounded(done.summaries) == rounded(want)
    limit = quantiles(done.transactions, {"limit": ("TransactionAmount", LARGE_QUANTILE)}).first()["limit"]
    assert done.transactions.where(F.col("TransactionAmount") > limit).count() == done.transactions.agg(F.sum("IsLargeTransaction")).first()[0]


@pytest.mark.parametrize("scales", [(1.0, 1.0, 1.0), (1.0, 1000.0), (1000.0, 1.0)])
def test_versions_sum_up_as_all_rows_do(spark, scales):
    """With parts alike, and with a part so much larger than the other that the limit lies below some tail."""
    folder = new_folder(spark, "test-history")
    for i, scale in enumerate(scales):
        new = made(spark, 400, 1000 * i, scale, i)
        if i == 1:
            new = new.withColumn("CustomerAge", (F.length("TransactionID") * 10 + F.coalesce("LoginAttempts", F.lit(3))))  # a new column
        done = jobs.ingest(f"v{i}.0.0" if i else None, new, folder, f"v{i + 1}.0.0", str(i))
        check(done)


def test_summaries_read_no_old_rows(spark):
    folder = new_folder(spark, "test-history")
    jobs.ingest(None, made(spark, 300, 0), folder, "v1.0.0", "1")
    done = jobs.ingest("v1.0.0", made(spark, 300, 1000, seed=1), folder, "v2.0.0", "2")
    parts = jobs.version_parts(spark, folder, "v2.0.0")
    assert len(parts) == 2
    limit, tails = H.tail_limit(spark, parts, LARGE_QUANTILE)
    states = H.merge_states([spark.read.parquet(f"{folder}/version=v1.0.0/{jobs.STATES}"), H.daily_states(spark.read.parquet(parts[1]), "Location", "TransactionDate")])
    read = H.summaries_of(states, H.large_counts(tails, limit.scalar())).inputFiles()
    assert not any(parts[0].rsplit("/", 2)[1] in f and "processed_transactions" in f for f in read)
    assert any("processed_transactions" in f for f in read) and any("daily_states" in f for f in read) and any("tail.parquet" in f for f in read)
    check(done)


def test_a_guess_that_misses_is_widened(spark):
    folder = new_folder(spark, "test-history")
    jobs.ingest(None, made(spark, 500, 0), folder, "v1.0.0", "1")
    parts = jobs.version_parts(spark, folder, "v1.0.0")
    rows = spark.read.parquet(parts[0])
    want = quantiles(rows, {"limit": ("TransactionAmount", 0.95)}).first()["limit"]
    for margin in (0.005, 0.04, -0.04, -1.0):  # the last two start above the wanted rank
        assert H.tail_limit(spark, parts, 0.95, margin)[0].first()["limit"] == want
    assert H.tail_limit(spark, parts, 0.5) is None


def test_quantiles_above_known_values(spark):
    rng = random.Random(5)
    values = sorted(rng.lognormvariate(0, 2) for _ in range(2000))
    every, upper = (spark.createDataFrame([(v,) for v in rows], "x double") for rows in (values, values[1500:]))
    for p in (0.8, 0.95, 0.9999, 1.0):
        assert quantiles(upper, {"q": ("x", p)}, below=1500).first()["q"] == quantiles(every, {"q": ("x", p)}).first()["q"]
