"""Streams over files that arrive one after the other.

Each function takes a streaming frame and starts a query that stops once all present files are read (``availableNow``); a
scheduler may start it again with the same checkpoint folder to go on. Results are tables, never memory sinks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from alertlake.operators import detectors as D
from alertlake.operators.skew import MINUTE
from alertlake.operators.summary import breaches
from alertlake.plans.jobs import upload_alerts
from alertlake.sources.readers import month_label

BATCH = "batch_id"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "csv", files_per_batch: int = 1) -> DataFrame:
    """New files of a folder, oldest first, a bounded number per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if kind == "csv":
        # A file with another header is an error; its columns are not taken by position.
        reader = reader.option("header", True).option("nullValue", "null").option("enforceSchema", False)
    return reader.format(kind).load(path)


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Start streams with this many state partitions. The number is fixed by a stream's first start, so choose it for the data
    expected; a stream keeps a copy of the settings it was started with.
    """
    before = spark.conf.get(PARTITIONS_KEY)
    if partitions:
        spark.conf.set(PARTITIONS_KEY, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS_KEY, before)


def _append(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def breach_stream(counts: DataFrame, out: str, checkpoint: str, threshold: int = 30) -> StreamingQuery:
    """Append the days above the threshold as each month's file arrives."""
    labelled = counts.select("date", month_label(F.col("_metadata.file_path")).alias("month"), "alert_count")
    return _append(breaches(labelled, threshold), out, checkpoint)


def upload_alert_stream(rows: DataFrame, out: str, checkpoint: str, run_id: str, limits: D.Limits = D.UPLOAD) -> StreamingQuery:
    """Judge each batch of uploaded rows by itself. A batch that is run again replaces its own folder."""
    def judge(batch: DataFrame, batch_id: int) -> None:
        rows_once = batch.persist()
        try:
            alerts = upload_alerts(rows_once, f"{run_id}-{batch_id:06d}", limits)
            alerts.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
        finally:
            rows_once.unpersist()

    return rows.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _upsert(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's changed aggregates under the batch's own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    return (df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest state of each key of an upserted table."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
    return newest.select(*keys, "v.*")


def daily_average_stream(log: DataFrame, value: str, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Average per day; rows later than ``late`` behind the newest are dropped."""
    days = (
        log.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day").alias("w"))
        .agg(F.avg(value).alias(f"average_{value}"))
        .select(F.to_date("w.start").alias("date"), f"average_{value}")
    )
    return _upsert(days, out, checkpoint)


def sliding_count_stream(rows: DataFrame, out: str, checkpoint: str, size: str = "1 day", step: str = "6 hours",
                         late: str = "1 hour", ts: str = "timestamp") -> StreamingQuery:
    """Counts over overlapping windows."""
    counts = (
        rows.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w")).agg(F.count(F.lit(1)).alias("alert_count"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "alert_count")
    )
    return _upsert(counts, out, checkpoint)


VELOCITY_OUTPUT = "CustomerID string, TransactionID string, TransactionDate timestamp, gap_micros bigint"
VELOCITY_STATE = "customers array<string>, slices array<bigint>, lasts array<bigint>"


def velocity_stream(rows: DataFrame, out: str, checkpoint: str, minutes: float = 5, late: str = "10 minutes",
                    groups: int | None = None) -> StreamingQuery:
    """Rows less than ``minutes`` after the customer's previous row, across batches.

    Customers and time slices are hashed to ``groups``; a group's state is the newest time of each of its customers, without
    those the watermark has left behind. A very busy customer is spread over groups by slice, and rows near a slice's end are
    also handed to the next slice, as in the batch operator. Rows that arrive out of order across batches are compared with the
    newest row seen, so files are expected in time order.
    """
    reach = int(minutes * MINUTE)
    width = 12 * reach
    groups = groups or 2 * int(rows.sparkSession.conf.get(PARTITIONS_KEY))
    us = F.unix_micros("TransactionDate")
    keyed = (
        rows.select("CustomerID", "TransactionID", "TransactionDate").where(F.col("CustomerID").isNotNull())
        .withWatermark("TransactionDate", late)
        .withColumn("us", us).withColumn("own", F.floor(us / F.lit(width)))
        .withColumn("slice", F.explode(F.sequence(F.col("own"), F.floor((F.col("us") + reach) / F.lit(width)))))
        .withColumn("native", F.col("slice") == F.col("own"))
        .withColumn("group", F.pmod(F.xxhash64("CustomerID", "slice"), F.lit(groups)))
    )

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        part = pd.concat(list(frames), ignore_index=True).sort_values(["CustomerID", "slice", "us", "TransactionID"], ignore_index=True)
        known = pd.DataFrame(dict(zip(("CustomerID", "slice", "last"), state.get if state.exists else ([], [], []))))
        known = known.astype({"CustomerID": object, "slice": "int64", "last": "int64"})
        keys = ["CustomerID", "slice"]
        before = part[keys].merge(known, on=keys, how="left")["last"]
        gaps = part.groupby(keys)["us"].diff().fillna(part["us"] - before)
        found = part.assign(gap_micros=gaps)[part["native"] & (gaps < reach)]
        newest = pd.concat([known, part[[*keys, "us"]].rename(columns={"us": "last"})]).groupby(keys, as_index=False)["last"].max()
        newest = newest[newest["last"] >= state.getCurrentWatermarkMs() * 1000 - reach]
        state.update(tuple(newest[c].tolist() for c in ("CustomerID", "slice", "last")))
        state.setTimeoutTimestamp(max(int(part["us"].max()) // 1000 + 2 * width // 1000, state.getCurrentWatermarkMs() + 1))
        if len(found):
            yield found[["CustomerID", "TransactionID", "TransactionDate", "gap_micros"]].astype({"gap_micros": "int64"})

    flagged = keyed.groupBy("group").applyInPandasWithState(
        follow, VELOCITY_OUTPUT, VELOCITY_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _append(flagged, out, checkpoint)


CLOCK = "rows bigint, late bigint, newest bigint"


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _newest(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """Newest time, in microseconds, of all batches up to this one: a single stored number."""
    if batch_id < 0:
        return None
    return spark.read.schema(CLOCK).parquet(f"{out}/clock/{BATCH}={batch_id}").first()["newest"]


def _split_late(batch: DataFrame, batch_id: int, ts: str, late: int, out: str) -> tuple[DataFrame, int | None, int | None]:
    """Write a batch's late rows and its clock; give its other rows and the watermarks before and after it.

    A row is late when its time lies before the newest time of the *earlier* batches less ``late``; one without a time is late too.
    Late rows keep all their columns. The numbers of rows come from the write itself, so nothing is scanned for them.
    """
    spark = batch.sparkSession
    before = _newest(spark, out, batch_id - 1)
    edge = None if before is None else before - late
    is_late = F.col(ts).isNull() if edge is None else F.coalesce(_micros(ts) < edge, F.lit(True))
    seen = Observation()
    counted = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(is_late).alias("late"), F.max(_micros(ts)).alias("newest"))
    counted.where(is_late).write.mode("overwrite").parquet(f"{out}/late/{BATCH}={batch_id}")
    found = seen.get
    newest = max((x for x in (before, found["newest"]) if x is not None), default=None)
    spark.createDataFrame([(found["rows"], found["late"], newest)], CLOCK).coalesce(1) \
        .write.mode("overwrite").parquet(f"{out}/clock/{BATCH}={batch_id}")
    return batch.where(~is_late), edge, None if newest is None else newest - late


def _micros_of(span: str) -> int:
    return pd.Timedelta(span).value // 1000


def counted_window_stream(rows: DataFrame, values: list[str], out: str, checkpoint: str, size: str = "1 day", step: str | None = None,
                          late: str = "1 hour", ts: str = "timestamp") -> StreamingQuery:
    """Counts and averages over windows, with every late row kept in a side table instead of being dropped.

    Each batch writes its partial sums, its late rows and its clock under its own number, so a batch that runs again replaces itself
    and nothing but one number is handed on. ``window_totals`` merges the parts; ``late_rows`` and ``clock`` tell the rest:
    the rows of all batches are the rows counted and the rows late.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        rows_once = batch.persist()
        try:
            on_time, _, _ = _split_late(rows_once, batch_id, ts, _micros_of(late), out)
            window = F.window(F.col(ts).cast("timestamp"), size, step) if step else F.window(F.col(ts).cast("timestamp"), size)
            sums = [e for v in values for e in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"count_{v}"))]
            parts = on_time.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("records"), *sums)
            parts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "records",
                         *[f"{kind}_{v}" for v in values for kind in ("sum", "count")]).write.mode("overwrite").parquet(f"{out}/windows/{BATCH}={batch_id}")
        finally:
            rows_once.unpersist()

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_totals(spark: SparkSession, out: str) -> DataFrame:
    """Per window: ``records`` and ``average_<value>`` over all batches."""
    parts = spark.read.parquet(f"{out}/windows")
    values = [c.removeprefix("sum_") for c in parts.columns if c.startswith("sum_")]
    return parts.groupBy("window_start", "window_end").agg(
        F.sum("records").alias("records"), *[F.try_divide(F.sum(f"sum_{v}"), F.sum(f"count_{v}")).alias(f"average_{v}") for v in values])


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came behind the watermark, with the batch they came in."""
    return spark.read.parquet(f"{out}/late")


def clock(spark: SparkSession, out: str) -> DataFrame:
    """Per batch: rows, late rows, and the newest time up to it in microseconds."""
    return spark.read.parquet(f"{out}/clock")


VELOCITY_ROW = ["CustomerID", "TransactionID", "TransactionDate"]


def _rapid_between(rows: DataFrame, minutes: float, low: int | None, high: int | None) -> DataFrame:
    """Rapid rows with a time from ``low`` up to ``high``; earlier rows serve as their predecessors only."""
    us = _micros("TransactionDate")
    known = rows if high is None else rows.where(us < high)
    found = D.rapid_rows(known, minutes)
    return (found if low is None else found.where(us >= low)).select(
        *VELOCITY_ROW, F.round(F.col("gap_minutes") * MINUTE).cast("bigint").alias("gap_micros"))


def unordered_velocity_stream(rows: DataFrame, out: str, checkpoint: str, minutes: float = 5, late: str = "10 minutes") -> StreamingQuery:
    """As ``velocity_stream`` for rows that come in any order within ``late``: the answer is the batch operator's.

    Rows are held until the watermark has passed them; then no earlier row can come, and they are judged in order of time. What a
    batch hands on is a table of the rows the watermark hasn't passed and of those less than ``minutes`` behind it, so it is bounded
    by the time range, not by the history, and customers are spread by time slices as in the batch operator. It is a table rather than a
    keyed state since the engine drops late rows before any state function sees them; here they are kept in ``late_rows``. A batch that
    runs again reads what the batch before wrote and replaces its own folders. ``velocity_found`` reads the result.
    """
    reach = int(minutes * MINUTE)

    def release(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows_once = batch.persist()
        try:
            on_time, passed, edge = _split_late(rows_once, batch_id, "TransactionDate", _micros_of(late), out)
            known = on_time.select(*VELOCITY_ROW).where(F.col("CustomerID").isNotNull())
            if batch_id:
                known = spark.read.schema(known.schema).parquet(f"{out}/held/{BATCH}={batch_id - 1}").unionByName(known)
            us = _micros("TransactionDate")
            if edge is None:  # no row with a time so far
                found, held = _rapid_between(known, minutes, None, None).limit(0), known.limit(0)
            else:
                found, held = _rapid_between(known, minutes, passed, edge), known.where(us >= edge - reach)
            found.write.mode("overwrite").parquet(f"{out}/found/{BATCH}={batch_id}")
            held.write.mode("overwrite").parquet(f"{out}/held/{BATCH}={batch_id}")
        finally:
            rows_once.unpersist()

    return rows.writeStream.foreachBatch(release).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def velocity_found(spark: SparkSession, out: str, minutes: float = 5, late: str = "10 minutes", held: bool = True) -> DataFrame:
    """Rapid rows found so far. With ``held`` the rows still held are judged too, as if the stream ended here; it may go on all the same."""
    found = spark.read.parquet(f"{out}/found").drop(BATCH)
    last = clock(spark, out).agg(F.max_by(F.struct(BATCH, "newest"), BATCH).alias("c")).first()["c"]
    if not held or last is None or last["newest"] is None:
        return found
    rest = spark.read.parquet(f"{out}/held/{BATCH}={last[BATCH]}")
    return found.unionByName(_rapid_between(rest, minutes, last["newest"] - _micros_of(late), None))
