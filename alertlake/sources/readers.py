"""Scans of transaction files, processed datasets, logs, alert runs and monthly counts. All are lazy."""

from __future__ import annotations

import csv
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.functions.scalars import parse_time
from alertlake.operators.features import mark_large
from alertlake.schema import LOG_SCHEMAS, SUMMARY_SCHEMA, TRANSACTION_SCHEMA
from alertlake.workspace import read_or_empty

PROCESSED_PREFIX = "processed_"
SUMMARY_NAME = "branch_summaries"
LIMIT_PREFIX = "large_limit_"
NULL_TEXT = "null"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; ``null`` cells are NULL. Types are inferred only for files without a declared schema.

    With a schema, a file whose header differs from it is an error, not a shift of its columns.
    """
    reader = spark.read.option("header", True).option("nullValue", NULL_TEXT)
    reader = reader.schema(schema).option("enforceSchema", False) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def header_groups(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The CSV files of a file, folder or glob by their header. One line of each file is read."""
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(settings)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(settings)
    groups: dict[tuple[str, ...], list[str]] = {}
    for found in system.globStatus(hadoop) or []:
        files = system.listFiles(found.getPath(), True)
        while files.hasNext():
            file = files.next().getPath()
            if file.getName().startswith(("_", ".")):
                continue
            stream = system.open(file)
            try:
                codec = codecs.getCodec(file)
                reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
                line = reader.readLine()
            finally:
                stream.close()
            if line:
                header = tuple(name.strip() for name in next(csv.reader([line.lstrip("\ufeff")])))
                groups.setdefault(header, []).append(file.toString())
    return groups


def read_declared_csv(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    """CSV files with declared types for every known column they have; unknown columns stay text.

    Files are grouped by their headers, read under their own, and put together by column name; a column that a file lacks is NULL.
    """
    known = {f.name: f.dataType for f in declared.fields}
    groups = header_groups(spark, path)
    if not groups:
        return spark.read.option("header", True).csv(path)
    frames = [read_csv(spark, files, T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header]))
              for header, files in sorted(groups.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of a CSV file, or of all CSV files of a folder whatever columns each of them has."""
    return read_declared_csv(spark, path, TRANSACTION_SCHEMA)


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths that match, through the file system of the folder; names only, no data."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().toString() for status in (system.globStatus(hadoop) or []))


#: Datasets whose columns have declared types.
DECLARED = {"transactions": TRANSACTION_SCHEMA, "bank_transactions_data_2": TRANSACTION_SCHEMA, SUMMARY_NAME: SUMMARY_SCHEMA}


def scan_datasets(spark: SparkSession, folder: str, suffix: str = ".csv") -> tuple[dict[str, DataFrame], DataFrame]:
    """({name: frame}, table of what could not be read) of all ``processed_<name>`` files and of ``branch_summaries``."""
    found, failed = {}, []
    for path in list_files(spark, folder, f"{PROCESSED_PREFIX}*{suffix}") + list_files(spark, folder, f"{SUMMARY_NAME}{suffix}"):
        name = path.rstrip("/").rsplit("/", 1)[-1][: -len(suffix)].removeprefix(PROCESSED_PREFIX)
        try:
            if suffix != ".csv":
                found[name] = with_large_flag(spark, folder, name, spark.read.parquet(path))
            elif name in DECLARED:
                found[name] = read_declared_csv(spark, path, DECLARED[name])
            else:
                found[name] = read_csv(spark, path)
        except (PySparkException, Py4JJavaError) as problem:  # the latter for files whose footer is not what their name says
            failed.append((name, path, str(problem)[:500]))
    return found, spark.createDataFrame(failed, "dataset string, path string, message string")


def read_datasets(spark: SparkSession, folder: str, suffix: str = ".csv") -> dict[str, DataFrame]:
    """{name: frame} of what can be read; ``scan_datasets`` tells what could not."""
    return scan_datasets(spark, folder, suffix)[0]


def with_large_flag(spark: SparkSession, folder: str, name: str, rows: DataFrame) -> DataFrame:
    """Large amounts are marked against the limit that was stored beside the dataset, so that rows needn't be written again for it."""
    if "TransactionAmount" not in rows.columns or not list_files(spark, folder, f"{LIMIT_PREFIX}{name}.parquet"):
        return rows
    return mark_large(rows, spark.read.schema("limit double").parquet(f"{folder.rstrip('/')}/{LIMIT_PREFIX}{name}.parquet").scalar())


def read_log(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Log lines of one kind with their time parsed; an absent folder gives an empty frame with the same columns."""
    schema = LOG_SCHEMAS[kind]
    lines = read_or_empty(spark, lambda: spark.read.schema(schema).json(path), schema)
    return lines.drop("run_id").withColumn("timestamp", parse_time(F.col("timestamp")))


def latest_run(alerts: DataFrame) -> DataFrame:
    """Alerts of the newest run. ``run_id`` is a partition column, so only that folder is read."""
    newest = alerts.agg(F.max("run_id").alias("run_id")).scalar()
    return alerts.where(F.col("run_id") == newest)


MONTH_IN_PATH = r"[/=](\d{1,2})-(\d{2})(?:\.csv)?(?:/[^/]*)?$"


def read_monthly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts from files or folders named month-year, such as 1-25.csv, with the month's full name."""
    rows = read_csv(spark, folder, "date date, alert_count bigint")
    return rows.select("date", month_label(F.col("_metadata.file_path")).alias("month"), "alert_count")


def month_label(path: Column) -> Column:
    """'January 2025' for a path that ends in 1-25.csv."""
    month, year = (F.regexp_extract(path, MONTH_IN_PATH, i).try_cast("int") for i in (1, 2))
    return F.date_format(F.make_date(year + 2000, month, F.lit(1)), "MMMM yyyy")
