"""Data versions as append-only tables: a row per version, an edge per operation, an immutable snapshot per version."""

from __future__ import annotations

import math
import time
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.functions.scalars import next_version
from alertlake.schema import HISTORY_SCHEMA, LINEAGE_SCHEMA, VERSION_DOCUMENT_SCHEMA
from alertlake.workspace import read_or_empty, store

FIRST_VERSION = "v0.0.0"
CREATED = "create_new_version"

# How two versions relate.
B_FROM_A = "B is direct descendant of A"
A_FROM_B = "A is direct descendant of B"
COMMON = "Common ancestors: "
UNRELATED = "No common ancestry"


def current_version(lineage: DataFrame) -> DataFrame:
    """The version the last operation made current, as one row; v0.0.0 before any operation."""
    last = lineage.agg(F.max_by("version", F.struct("timestamp", "seq")).alias("version"))
    return last.select(F.coalesce("version", F.lit(FIRST_VERSION)).alias("version"))


def following_version(current: Column, stamp: Column) -> Column:
    """Next version after ``current``; ``stamp`` names it when the current one does not parse."""
    return next_version(current, stamp)


def first_parents(lineage: DataFrame) -> DataFrame:
    """One parent per version: that of its first entry, as later entries only restore it."""
    first = F.min(F.struct("timestamp", "seq", "parent")).alias("f")
    return lineage.groupBy("version").agg(first).select("version", F.col("f.parent").alias("parent")).where(
        F.col("parent").isNotNull() & (F.col("parent") != F.col("version")))


def ancestry(lineage: DataFrame, starts: DataFrame) -> DataFrame:
    """(version, ancestor) for every start, the version itself included. Cycles end where they close.

    Jumps double each round, so a chain of n versions takes about log2(n) joins instead of n. Both tables are written to the
    shared folder each round, which keeps the plan flat and survives lost executors.
    """
    jumps = store(first_parents(lineage), "jumps")
    reached = starts.select(F.col("version"), F.col("version").alias("ancestor")).distinct()
    edges = jumps.count()
    known = -1
    for _ in range(max(1, math.ceil(math.log2(edges + 1)) + 1)):
        step = reached.join(jumps.withColumnsRenamed({"version": "_from", "parent": "_to"}), F.col("ancestor") == F.col("_from"))
        reached = store(reached.unionByName(step.select("version", F.col("_to").alias("ancestor"))).distinct(), "reached")
        count = reached.count()
        if count == known:
            break
        known = count
        further = jumps.withColumnsRenamed({"version": "_from", "parent": "_to"})
        jumps = store(jumps.join(further, F.col("parent") == F.col("_from")).select("version", F.col("_to").alias("parent")), "jumps")
    return reached


def common_ancestors(lineage: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    reached = ancestry(lineage, a.select("version").union(b.select("version")))
    of_a = reached.join(a.select("version"), "version", "left_semi").select("ancestor")
    of_b = reached.join(b.select("version"), "version", "left_semi").select("ancestor")
    return of_a.intersect(of_b)


def new_ids(older: DataFrame, newer: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Distinct ids of the newer rows that the older rows lack."""
    return newer.select(key).distinct().join(older.select(key), key, "left_anti")


def compare(older: DataFrame, newer: DataFrame, versions: DataFrame, lineage: DataFrame, a: str, b: str,
            key: str = "TransactionID") -> DataFrame:
    """Count difference, new ids, days apart and lineage relation of versions ``a`` and ``b``.

    Both snapshots are tagged and grouped by id once; the counts of rows and of new ids come from that one aggregation.
    """
    sides = older.select(F.lit(0).alias("side"), F.col(key)).unionByName(newer.select(F.lit(1).alias("side"), F.col(key)))
    per_id = sides.groupBy(key).agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    counts = per_id.agg(
        F.coalesce(F.sum(F.col("nb") - F.col("na")), F.lit(0)).cast("bigint").alias("transaction_count_difference"),
        F.count_if((F.col("na") == 0) & (F.col("nb") > 0) & F.col(key).isNotNull()).alias("new_records_count"))
    both = versions.where(F.col("version").isin(a, b)).agg(
        F.max(F.when(F.col("version") == a, F.col("created_at"))).alias("created_a"),
        F.max(F.when(F.col("version") == b, F.col("created_at"))).alias("created_b"),
        F.max(F.when(F.col("version") == a, F.col("notes"))).alias("notes_a"),
        F.max(F.when(F.col("version") == b, F.col("notes"))).alias("notes_b"))
    direct = lineage.agg(
        F.coalesce(F.bool_or((F.col("version") == b) & (F.col("parent") == a)), F.lit(False)).alias("b_from_a"),
        F.coalesce(F.bool_or((F.col("version") == a) & (F.col("parent") == b)), F.lit(False)).alias("a_from_b"))
    spark = versions.sparkSession
    shared = common_ancestors(lineage, spark.createDataFrame([(a,)], "version string"), spark.createDataFrame([(b,)], "version string"))
    # As many names as two lineages share; versions are few compared with rows.
    names = shared.agg(F.array_join(F.sort_array(F.collect_list("ancestor")), ", ").alias("names")).scalar()
    created = counts.select(
        F.lit(a).alias("version_a"), F.lit(b).alias("version_b"), "transaction_count_difference", "new_records_count",
        both.select(F.struct("*")).scalar().alias("_v"), direct.select(F.struct("*")).scalar().alias("_d"), names.alias("_n"))
    return created.select(
        "version_a", "version_b", F.col("_v.created_a").alias("creation_date_a"), F.col("_v.created_b").alias("creation_date_b"),
        (F.timestamp_diff("MICROSECOND", F.col("_v.created_a"), F.col("_v.created_b")) / 86400e6).alias("time_difference_days"),
        "transaction_count_difference", "new_records_count", F.col("_v.notes_a").alias("notes_a"), F.col("_v.notes_b").alias("notes_b"),
        F.when(F.col("_d.b_from_a"), B_FROM_A).when(F.col("_d.a_from_b"), A_FROM_B)
        .when(F.col("_n") != "", F.concat(F.lit(COMMON), F.col("_n"))).otherwise(UNRELATED).alias("lineage_relation"))


def version_summary(versions: DataFrame) -> DataFrame:
    """Records, number of files and whether old data was merged in, per version."""
    return versions.select(
        "version", "parent_version", "created_at", F.coalesce("notes", F.lit("No notes available")).alias("notes"),
        "processed_records", F.greatest(F.size("processed_files"), F.lit(0)).alias("files"),
        F.when(F.coalesce("merge_with_existing", F.lit(False)), "Yes").otherwise("No").alias("merged"))


def import_document(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """Version and lineage rows out of JSON version documents."""
    parsed = documents.select("*", F.from_json(F.col(column), VERSION_DOCUMENT_SCHEMA).alias("_d")).drop(column)
    others = [c for c in documents.columns if c != column]
    rows = parsed.select(*others, F.col("_d.current_version").alias("current_version"), F.explode("_d.versions").alias("version", "v"))
    versions = rows.select(
        *others, "version", F.col("v.parent_version").alias("parent_version"),
        F.try_to_timestamp(F.col("v.created_at")).cast("timestamp_ntz").alias("created_at"), F.col("v.notes").alias("notes"),
        F.col("v.processing_info.processed_records").alias("processed_records"),
        F.col("v.processing_info.processed_files").alias("processed_files"),
        F.col("v.processing_info.merge_with_existing").alias("merge_with_existing"),
        (F.col("version") == F.col("current_version")).alias("is_current"))
    edges = parsed.select(*others, F.posexplode("_d.data_lineage").alias("seq", "e")).select(
        *others, "e.version", "e.parent", F.try_to_timestamp(F.col("e.timestamp")).cast("timestamp_ntz").alias("timestamp"),
        "e.operation", "e.notes", F.col("seq").cast("bigint").alias("seq"))
    return versions, edges


class VersionStore:
    """Versions kept under one folder: ``history`` with a row per operation, and ``snapshots/version=<v>``.

    An operation is one append, so a version and its edge are there together or not at all. Operations are ordered by their time,
    then by the moment they were written. Only the history's few rows are ever read on the driver; snapshots stay on disk and are
    never changed, so a rollback is one more row.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _history(self) -> DataFrame:
        return read_or_empty(self.spark, lambda: self.spark.read.schema(HISTORY_SCHEMA).parquet(f"{self.root}/history"), HISTORY_SCHEMA)

    def versions(self) -> DataFrame:
        made = self._history().where(F.col("operation") == CREATED)
        return made.select("version", F.col("parent").alias("parent_version"), F.col("timestamp").alias("created_at"), "notes",
                           "processed_records", "processed_files", "merge_with_existing")

    def lineage(self) -> DataFrame:
        return self._history().select(*[f.name for f in LINEAGE_SCHEMA.fields])

    def current(self) -> str:
        return current_version(self.lineage()).first()["version"]

    def info(self, version: str | None = None) -> DataFrame:
        version = version or self.current()
        found = self.versions().where(F.col("version") == version)
        if found.isEmpty():
            raise ValueError(f"version {version} is unknown")
        return found

    def create(self, notes: str, at: str, rows: DataFrame | None = None, merged: bool = False) -> str:
        """Add a version after the current one, with a snapshot of ``rows`` when given.

        After a rollback the next number may be taken already; the version then follows the highest one.
        """
        current = self.current()
        stamp = "".join(c for c in at if c.isdigit())[:14]
        taken = self.versions().select("version").distinct()
        after = taken.select("version").unionByName(self.spark.createDataFrame([(current,)], "version string")).select(
            (F.col("version") == current).alias("wanted"), next_version(F.col("version"), F.lit(stamp)).alias("next"))
        free = after.distinct().join(taken, F.col("next") == F.col("version"), "left_anti")
        number = F.regexp_extract("next", r"(\d+)", 1).cast("decimal(38,0)")
        version = free.orderBy(F.desc("wanted"), F.desc(number)).first()["next"]
        records = None
        files: list[str] = []
        if rows is not None:
            path = f"{self.root}/snapshots/version={version}"
            rows.write.parquet(path)
            records, files = self.spark.read.schema(rows.schema).parquet(path).count(), [path]
        self._append(version, current, at, CREATED, notes, records, files, merged)
        return version

    def _append(self, version: str, parent: str, at: str, operation: str, notes: str, records: int | None = None,
                files: list[str] | None = None, merged: bool | None = None) -> None:
        row = (version, parent, datetime.fromisoformat(at), operation, notes, time.time_ns(), records, files or [], merged)
        self.spark.createDataFrame([row], HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/history")

    def as_of(self, version: str | None = None) -> DataFrame:
        """The rows of a version. The version is a partition folder, so nothing else is read."""
        version = version or self.current()
        return self.spark.read.parquet(f"{self.root}/snapshots/version={version}")

    def rollback(self, version: str, at: str) -> bool:
        """Make an old version current again, after a restore point for the present one. False when it is unknown."""
        if self.versions().where(F.col("version") == version).isEmpty():
            return False
        current = self.current()
        self.create(f"Restore point before rollback to {version}", at)
        self._append(version, current, at, "rollback_to_version", f"Rolled back from {current} to {version}")
        return True

    def compare(self, a: str, b: str, key: str = "TransactionID") -> DataFrame:
        for version in (a, b):
            self.info(version)
        return compare(self.as_of(a), self.as_of(b), self.versions(), self.lineage(), a, b, key)
