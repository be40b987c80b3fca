"""Cleaning: times, NaN, duplicates, standardised numbers, and columns an upload may lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.functions.scalars import no_nan, parse_time
from alertlake.operators.skew import number_rows
from alertlake.schema import existing, quoted

TIME_COLUMNS = ["TransactionDate", "PreviousTransactionDate", "Date"]
RISK_LIMIT = 0.7


def clean(df: DataFrame, time_columns: list[str] | None = None) -> DataFrame:
    """Parse times that are text, turn NaN into NULL, remove rows that repeat in full."""
    changes = {}
    for c in existing(df, time_columns or TIME_COLUMNS):
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            changes[c] = parse_time(quoted(c))
        elif isinstance(kind, T.DateType):
            changes[c] = quoted(c).cast("timestamp_ntz")
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changes[field.name] = no_nan(quoted(field.name))
    return df.withColumns(changes).dropDuplicates()


def standardise(df: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes zero."""
    if not columns:
        return df
    moments = df.agg(F.struct(
        *[F.avg(no_nan(quoted(c))).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(no_nan(quoted(c))).alias(f"s{i}") for i, c in enumerate(columns)],
    ).alias("moments")).scalar()
    scaled = {}
    for i, c in enumerate(columns):
        spread = moments.getField(f"s{i}")
        scaled[c + suffix] = (no_nan(quoted(c)) - moments.getField(f"m{i}")) / F.when(spread == 0, 1.0).otherwise(spread)
    return df.withColumns(scaled)


def backfill_ids(df: DataFrame, order: str, first: int = 1000, name: str = "TransactionID") -> DataFrame:
    """Give rows ids TX001000, TX001001, ... along ``order`` when the id column is missing."""
    if name in df.columns:
        return df
    numbered = number_rows(df, order, "_number")
    text = (F.col("_number") + (first - 1)).cast("string")
    padded = F.when(F.length(text) >= 6, text).otherwise(F.lpad(text, 6, "0"))
    return numbered.withColumn(name, F.concat(F.lit("TX"), padded)).drop("_number")


def backfill_fraud_flag(df: DataFrame, limit: float = RISK_LIMIT) -> DataFrame:
    """Derive the fraud flag from the risk score, or set it to false, when the column is missing."""
    if "FraudFlag" in df.columns:
        return df
    if "FraudRiskScore" in df.columns:
        return df.withColumn("FraudFlag", F.coalesce(no_nan(F.col("FraudRiskScore")) > limit, F.lit(False)))
    return df.withColumn("FraudFlag", F.lit(False))
