"""Append-only sinks. Everything goes out in bulk as partitioned tables; nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.schema import LOG_SCHEMAS


def append_log(df: DataFrame, path: str, kind: str, run_id: str | None = None) -> None:
    """Append log records of one kind as JSON lines, one folder per day.

    With ``run_id`` they go to the run's folder of each day; a run that is repeated replaces its own lines, so a job that is started again
    doesn't log twice. A log takes lines with runs or lines without, not both. Rebalancing by day keeps each day in few files of even size; adaptive execution splits a day that is much larger.
    """
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
              for f in LOG_SCHEMAS[kind].fields if f.name != "timestamp"]
    text = F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    lines = df.select(text, *fields, F.to_date("timestamp").alias("log_date"))
    if run_id is None:
        lines.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").json(path)
        return
    lines = lines.withColumn("run_id", F.lit(run_id)).hint("rebalance", "log_date")
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "run_id").json(path)


def usage_records(df: DataFrame) -> DataFrame:
    """Usage with its token total."""
    return df.withColumn("tokens_total", F.col("tokens_prompt") + F.col("tokens_completion"))


def judged_feedback(df: DataFrame) -> DataFrame:
    """All feedback, marked ``valid`` when its quality is from 1 to 5. What to do with the rest is the reader's choice."""
    return df.withColumn("valid", F.coalesce(F.col("alert_quality").between(1, 5), F.lit(False)))


def save_alerts(alerts: DataFrame, path: str) -> None:
    """Write a run's alerts under its run_id. A run that is repeated replaces its own alerts and no others; one without alerts
    writes no folder."""
    alerts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def save_processed(df: DataFrame, folder: str, name: str) -> str:
    """Write a processed dataset as ``processed_<name>`` (or the summaries under their own name)."""
    target = f"{folder.rstrip('/')}/{name if name == 'branch_summaries' else 'processed_' + name}.parquet"
    df.write.parquet(target)
    return target


def save_embeddings(df: DataFrame, path: str) -> None:
    """One table of id, text, vector and metadata, a folder per collection."""
    df.write.mode("append").partitionBy("collection").parquet(path)


def new_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose id the collection does not hold yet; the first of repeated incoming ids is kept."""
    keys = ["collection", "id"]
    unseen = incoming.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)
    row = F.struct(*[F.col(c) for c in incoming.columns])
    # Only unseen rows are grouped; the choice among repeats follows their content, so it is the same on every run.
    return unseen.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*incoming.columns)).alias("row")).select("row.*")
