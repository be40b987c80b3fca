"""Whole jobs: process datasets, ingest a file as a new version, refresh vectors and alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.functions.text import summary_metadata, summary_text, transaction_metadata, transaction_text
from alertlake.functions.vectors import byte_sum, hash_embedding
from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.operators import history as H
from alertlake.operators.clean import backfill_fraud_flag, backfill_ids, clean, standardise
from alertlake.operators.features import LARGE_QUANTILE, row_features
from alertlake.operators.quantiles import quantiles
from alertlake.operators.retrieval import COLLECTIONS
from alertlake.operators.summary import daily_summaries
from alertlake.schema import DATE_COLUMNS, existing, pick, quoted
from alertlake.sources.readers import LIMIT_PREFIX, list_files, read_datasets, read_transactions_csv, with_large_flag
from alertlake.sources.sinks import new_only, save_alerts, save_processed
from alertlake.workspace import read_or_empty, store


def process_datasets(raw: dict[str, DataFrame], folder: str, credit: str = "Credit", scaled: bool = False) -> dict[str, DataFrame]:
    """Clean every dataset, add features, write it, and write branch summaries of the transactions. Returns what was written.

    Cleaned rows are shuffled and written once. The limit of large amounts is then taken from one column of what was written, and
    kept beside it; readers mark large amounts by it. ``scaled`` adds ``_z`` columns with the standardised amounts and login attempts.
    """
    spark = next(iter(raw.values())).sparkSession
    for name, df in raw.items():
        featured = row_features(clean(df), credit)
        if scaled:
            featured = store(featured, f"cleaned-{name}")  # moments and rows come from one cleaning
            featured = standardise(featured, existing(featured, ["TransactionAmount", "LoginAttempts"]), "_z")
        path = save_processed(featured, folder, name)
        if "TransactionAmount" in df.columns:
            save_limit(spark.read.parquet(path), folder, name)
    if "transactions" in raw:
        # Summaries are taken from the written table, so cleaning runs once.
        written = with_large_flag(spark, folder, "transactions", spark.read.parquet(f"{folder}/processed_transactions.parquet"))
        if pick(written, *DATE_COLUMNS) and pick(written, "Location", "BranchID"):
            save_processed(daily_summaries(written), folder, "branch_summaries")
    return read_datasets(spark, folder, ".parquet")


def save_limit(rows: DataFrame, folder: str, name: str) -> None:
    """Keep the amount above which a transaction of these rows is large: one number."""
    limit = quantiles(rows.select("TransactionAmount"), {"limit": ("TransactionAmount", LARGE_QUANTILE)})
    limit.write.parquet(f"{folder.rstrip('/')}/{LIMIT_PREFIX}{name}.parquet")


def upload_alerts(rows: DataFrame, run_id: str, limits: D.Limits = D.UPLOAD) -> DataFrame:
    """Alerts of one upload, with the rows behind them: the general insight and one alert per anomaly, low severity included."""
    judged = backfill_fraud_flag(rows)
    rules = D.row_rules(judged, limits)  # once, as the limit of large amounts takes some passes
    behind = A.related_rows(judged, limits, rules=rules)
    return A.basic_alerts(D.union_all([D.general_insight(judged), D.detect_upload(judged, limits, rules=rules)]), run_id, 0.0, behind)


def analyze_csv(spark: SparkSession, path: str, run_id: str, limits: D.Limits = D.UPLOAD) -> DataFrame:
    """Alerts of a CSV file. The file is parsed once and kept as a table, since every detector reads it."""
    return upload_alerts(store(read_transactions_csv(spark, path), "upload"), run_id, limits)


def alert_run(spark: SparkSession, folder: str, alerts_path: str, run_id: str, suffix: str = ".parquet", threshold: float = 0.7) -> DataFrame:
    """Detect over every processed dataset of a folder, append the alerts as a run, and return what was written."""
    alerts = A.basic_alerts(D.detect_datasets(read_datasets(spark, folder, suffix)), run_id, threshold)
    save_alerts(alerts, alerts_path)
    saved = spark.read.schema(alerts.schema).json(alerts_path)
    return saved.where(F.col("run_id") == run_id)


@dataclass(frozen=True)
class Ingest:
    """What an ingest wrote: the snapshot of all rows, its summaries, and the alerts of the new rows."""

    transactions: DataFrame
    summaries: DataFrame
    alerts: DataFrame


PARTS = "parts.parquet"


def version_parts(spark: SparkSession, folder: str, version: str) -> list[str]:
    """Folders whose rows together are a version. As many as ingests before it."""
    rows = spark.read.schema("number int, path string").parquet(f"{folder.rstrip('/')}/version={version}/{PARTS}")
    return [r["path"] for r in rows.orderBy("number").collect()]


def read_version(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """All rows of a version, with large amounts marked by the version's own limit."""
    frames = [spark.read.parquet(path) for path in version_parts(spark, folder, version)]
    return with_large_flag(spark, f"{folder.rstrip('/')}/version={version}", "transactions", D.union_all(frames))


KEYS = ["_k1", "_k2"]
#: New rows are few if the keys held are this many times as many.
FEW = 10


def row_keys(df: DataFrame) -> DataFrame:
    """Add 128 bits that name a row: each value is hashed with its column's name, and the hashes are combined in any order.

    A NULL adds nothing, so a row keeps its key when its table gets another column, and a value tells in which column it stands.
    """
    def key(salt: str) -> Column:
        parts = [F.when(quoted(c).isNull(), 0).otherwise(F.xxhash64(F.lit(salt), F.lit(c), quoted(c))) for c in df.columns]
        return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.lit(0).cast("long"))

    return df.withColumns({"_k1": key("first"), "_k2": key("second")})


def keys_path(part: str) -> str:
    """The keys of a part's rows, beside the part."""
    return f"{part.rstrip('/').rsplit('/', 1)[0]}/keys.parquet"


def unknown_rows(keyed: DataFrame, parts: list[str], number: int = 0) -> DataFrame:
    """The rows whose keys no part holds. Parts are not read, only their keys, 16 bytes a row.

    If the rows, at most ``number``, are few beside the keys, the keys are reduced to the ones asked for before anything is sent back, so that
    they stay in place. Otherwise that would only add a second join of the same size.
    """
    spark, asked = keyed.sparkSession, keyed.select(*KEYS)
    held = D.union_all([spark.read.parquet(keys_path(p)) for p in parts])
    if number * FEW <= held.count():
        held = held.join(asked, KEYS, "left_semi")
    return keyed.join(held, KEYS, "left_anti")


def ingest(existing: DataFrame | str | None, new: DataFrame, folder: str, version: str, run_id: str, credit: str = "Credit",
           order: str | None = None, limits: D.Limits = D.UPLOAD) -> Ingest:
    """Merge new rows with existing ones as ``version``, and judge the new rows alone.

    ``existing`` is a version of the same folder, or a table of raw rows that the folder doesn't hold yet. A version is a list of
    parts: rows of earlier versions stay where they are, and only new rows that they lack are cleaned and written, once. Summaries
    and the limit of large amounts belong to the version, since new rows change them. Raw rows are kept beside the version.
    """
    spark, base = new.sparkSession, folder.rstrip("/")
    target = f"{base}/version={version}"
    new.write.parquet(f"{target}/raw.parquet")
    new = spark.read.schema(new.schema).parquet(f"{target}/raw.parquet")
    parts = version_parts(spark, base, existing) if isinstance(existing, str) else []
    merged = existing.unionByName(new, allowMissingColumns=True) if isinstance(existing, DataFrame) else new
    cleaned = clean(merged)
    keyed = row_keys(cleaned)
    keyed = store(unknown_rows(keyed, parts, new.count()) if parts else keyed, "new-rows")
    parts.append(save_processed(row_features(keyed.drop(*KEYS), credit), target, "transactions"))
    keyed.select(*KEYS).write.parquet(keys_path(parts[-1]))
    spark.createDataFrame(list(enumerate(parts)), "number int, path string").coalesce(1).write.parquet(f"{target}/{PARTS}")
    rows = sum_up(spark, base, version, existing if isinstance(existing, str) else None, parts)
    alerts = upload_alerts(backfill_ids(new, order) if order else new, run_id, limits)
    save_alerts(alerts, f"{base}/alerts")
    saved = spark.read.schema(alerts.schema).json(f"{base}/alerts").where(F.col("run_id") == run_id)
    return Ingest(rows, spark.read.parquet(f"{target}/branch_summaries.parquet"), saved)


STATES = "daily_states.parquet"


def sum_up(spark: SparkSession, base: str, version: str, before: str | None, parts: list[str]) -> DataFrame:
    """Write the limit of large amounts and the daily summaries of a version whose last part is new; returns the version's rows.

    States and tails of the parts are merged, and only the new part's rows are read. All rows are read if the columns for branch and day
    have changed since, if the version before has no states, or if the limit lies below the tails.
    """
    target, rows = f"{base}/version={version}", read_version(spark, base, version)
    branch, day = pick(rows, "Location", "BranchID"), pick(rows, *DATE_COLUMNS)
    if branch is None or day is None or "TransactionAmount" not in rows.columns:
        raise ValueError("summaries need a branch, a date and an amount")
    new = spark.read.parquet(parts[-1])
    lacking = {c: F.lit(None).cast(rows.schema[c].dataType) for c in (branch, day, "TransactionAmount") if c not in new.columns}
    new = new.withColumns(lacking)
    H.save_part(new, parts[-1], branch, day)
    held = before is None or bool(list_files(spark, f"{base}/version={before}", STATES))
    found = None
    if held and H.part_columns(spark, parts) == {(branch, day)}:
        earlier = [] if before is None else [spark.read.parquet(f"{base}/version={before}/{STATES}")]
        H.merge_states([*earlier, H.daily_states(new, branch, day)]).write.parquet(f"{target}/{STATES}")
        found = H.tail_limit(spark, parts, LARGE_QUANTILE)
    if found is None:
        save_limit(rows, target, "transactions")
        rows = read_version(spark, base, version)
        save_processed(daily_summaries(rows), target, "branch_summaries")
        return rows
    limit, tails = found
    limit.write.parquet(f"{target}/{LIMIT_PREFIX}transactions.parquet")
    rows = read_version(spark, base, version)
    large = H.large_counts(tails, spark.read.schema("limit double").parquet(f"{target}/{LIMIT_PREFIX}transactions.parquet").scalar())
    save_processed(H.summaries_of(spark.read.parquet(f"{target}/{STATES}"), large), target, "branch_summaries")
    return rows


def embedding_rows(transactions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Text and metadata of both collections, without vectors."""
    rows = transactions.select(
        F.lit("transactions").alias("collection"), F.col("TransactionID").cast("string").alias("id"),
        transaction_text(transactions).alias("text"), transaction_metadata().alias("metadata"))
    key = F.concat(F.lit("summary_"), F.col("Location"), F.lit("_"), F.col("Date").cast("string"))
    days = summaries.select(F.lit("summaries").alias("collection"), key.alias("id"), summary_text(summaries).alias("text"),
                            summary_metadata(summaries).alias("metadata"))
    return rows.unionByName(days)


def refresh(spark: SparkSession, stored: str, transactions: DataFrame, summaries: DataFrame, alerts_path: str, run_id: str) -> DataFrame:
    """Embed the rows the store lacks, append them, then write the alerts of the whole data. Returns the store as it is then.

    Collections are written one after the other, as a write of several sorts its rows, vectors included, by the collection. Rows whose
    texts have one byte sum, and so one vector, stand together in a file, which then holds little more than one of their vectors.
    """
    rows = embedding_rows(transactions, summaries)
    keys = "collection string, id string"
    for name in COLLECTIONS:
        have = read_or_empty(spark, lambda: spark.read.parquet(stored).select("collection", "id"), keys)
        added = new_only(*(df.where(F.col("collection") == name) for df in (have, rows)))
        near = added.withColumn("_seed", byte_sum(F.col("text"))).sortWithinPartitions("_seed").drop("_seed")
        vectors = near.withColumn("embedding", hash_embedding(F.col("text"))).drop("collection")
        vectors.write.mode("append").parquet(f"{stored.rstrip('/')}/collection={name}")
    found = D.detect_datasets({"transactions": transactions, "branch_summaries": summaries})
    save_alerts(A.basic_alerts(found, run_id), alerts_path)
    return spark.read.parquet(stored)
