"""Drift of metrics and of embeddings. ``as_of`` is always given, never taken from the clock."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertlake.functions.scalars import no_nan
from alertlake.functions.vectors import cosine_distance
from alertlake.operators.detectors import union_all
from alertlake.schema import quoted

# Reasons given when nothing can be compared.
NO_DATA = "No data available"
TOO_LITTLE = "Insufficient data"
SAMPLE_LIMIT = 1000


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def since(as_of: str, days: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")


def recent(log: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Records of the last ``days`` days."""
    return log.where(F.col("timestamp") >= since(as_of, days))


def metric_drift(log: DataFrame, value: str, as_of: str, baseline_days: int = 30, current_days: int = 7,
                 threshold: float = 20.0, falls_only: bool = False) -> DataFrame:
    """Mean of the last days against the mean of the days before, in one aggregation.

    Drift is a change beyond the threshold in either direction, or a fall beyond it with ``falls_only``.
    """
    ts, x = F.col("timestamp"), no_nan(quoted(value))
    is_current = ts >= since(as_of, current_days)
    is_base = (ts >= since(as_of, baseline_days)) & ~is_current
    row = log.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(is_base).alias("nb"), F.count_if(is_current).alias("nc"),
        F.avg(F.when(is_base, x)).alias("b"), F.avg(F.when(is_current, x)).alias("c"))
    change = F.try_divide(F.col("c") - F.col("b"), F.col("b")) * 100
    enough = (F.col("nb") > 0) & (F.col("nc") > 0)
    drifted = change < -threshold if falls_only else F.abs(change) > threshold
    return row.select(
        F.lit(value).alias("metric"),
        F.coalesce(enough & drifted, F.lit(False)).alias("drift_detected"),
        F.when(F.col("records") == 0, NO_DATA).when(~enough, TOO_LITTLE).alias("reason"),
        F.when(enough, F.col("b")).alias("baseline_value"),
        F.when(enough, F.col("c")).alias("current_value"),
        F.when(enough, change).alias("percent_change"),
        F.lit(float(-threshold if falls_only else threshold)).alias("threshold"))


def response_time_drift(log: DataFrame, as_of: str, baseline_days: int = 30, current_days: int = 7, threshold: float = 20.0) -> DataFrame:
    return metric_drift(log, "response_time_seconds", as_of, baseline_days, current_days, threshold)


def feedback_drift(log: DataFrame, as_of: str, baseline_days: int = 30, current_days: int = 7, threshold: float = 15.0) -> DataFrame:
    return metric_drift(log, "alert_quality", as_of, baseline_days, current_days, threshold, falls_only=True)


def embedding_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.1, vector: str = "embedding") -> DataFrame:
    """Cosine distance between the mean vectors of two tables."""
    def side(df: DataFrame, name: str) -> DataFrame:
        mean = vector_to_array(Summarizer.mean(array_to_vector(quoted(vector))))
        return df.where(quoted(vector).isNotNull()).groupBy(F.lit(name).alias("side")).agg(mean.alias("m"))

    both = side(baseline, "b").unionByName(side(current, "c")).agg(
        F.max(F.when(F.col("side") == "b", F.col("m"))).alias("b"), F.max(F.when(F.col("side") == "c", F.col("m"))).alias("c"))
    enough = F.col("b").isNotNull() & F.col("c").isNotNull()
    measured = both.withColumn("distance", F.when(enough, cosine_distance(F.col("b"), F.col("c"))))
    return measured.select(
        F.lit("embedding_cosine_distance").alias("metric"),
        F.coalesce(F.col("distance") > threshold, F.lit(False)).alias("drift_detected"),
        F.when(~enough, TOO_LITTLE).alias("reason"),
        F.col("distance"), F.lit(float(threshold)).alias("threshold"))


def daily_average(log: DataFrame, value: str) -> DataFrame:
    return log.where(F.col("timestamp").isNotNull()).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.avg(no_nan(quoted(value))).alias(f"average_{value}"))


def sample(df: DataFrame, size: int = SAMPLE_LIMIT, seed: int = 0, key: str = "id") -> DataFrame:
    """At most ``size`` rows in a fixed pseudo-random order of the key; each task sends only its own best ``size``."""
    return df.orderBy(F.xxhash64(quoted(key), F.lit(seed)), quoted(key)).limit(size)


def save_sample(df: DataFrame, path: str, taken: str, size: int = SAMPLE_LIMIT, key: str = "id") -> None:
    """Keep a sample under the time it was taken. One that is saved again replaces itself and no other."""
    kept = sample(df, size, key=key).withColumn("taken", F.lit(taken))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("taken").parquet(path)


def load_sample(spark: SparkSession, path: str) -> DataFrame:
    """The newest sample. ``taken`` is the partition column, so only its folder is read."""
    saved = spark.read.parquet(path).withColumn("taken", F.col("taken").cast("string"))
    return saved.where(F.col("taken") == saved.agg(F.max("taken")).scalar())


def plane(baseline: DataFrame, current: DataFrame, vector: str = "embedding", key: str = "id", size: int | None = None) -> DataFrame:
    """Both tables, or samples of ``size`` rows of each, on their two main axes, with each axis's share of the variance. Axes have no fixed sign."""
    baseline, current = (df if size is None else sample(df, size, key=key) for df in (baseline, current))
    both = baseline.withColumn("side", F.lit("baseline")).unionByName(current.withColumn("side", F.lit("current")))
    vectors = both.select(quoted(key).alias(key), "side", array_to_vector(quoted(vector)).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors)
    shares = [float(x) for x in model.explainedVariance.toArray()]
    points = model.transform(vectors).withColumn("_p", vector_to_array("_p"))
    return points.select(key, "side", F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"),
                         F.lit(shares[0]).alias("x_share"), F.lit(shares[1]).alias("y_share"))


def all_checks(performance: DataFrame, feedback: DataFrame, baseline: DataFrame | None, current: DataFrame | None, as_of: str) -> DataFrame:
    """All checks as rows, with whether any of them drifted."""
    frames = [response_time_drift(performance, as_of), feedback_drift(feedback, as_of)]
    if baseline is not None and current is not None:
        frames.append(embedding_drift(baseline, current))
    rows = union_all(frames)
    # Three rows at most.
    return rows.withColumn("any_drift_detected", F.bool_or("drift_detected").over(Window.partitionBy()))
