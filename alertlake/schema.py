"""Declared schemas and column resolution for frames whose columns differ between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_COLUMNS = ("TransactionDate", "Date")
SAMPLE_BRANCH_COLUMNS = ("BranchID", "Location")
SUMMARY_BRANCH_COLUMNS = ("Location", "BranchID")

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.StringType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("AccountID", T.StringType()),
    T.StructField("TransactionAmount", T.DoubleType()),
    T.StructField("TransactionDate", T.TimestampNTZType()),
    T.StructField("TransactionType", T.StringType()),
    T.StructField("Location", T.StringType()),
    T.StructField("BranchID", T.StringType()),
    T.StructField("Channel", T.StringType()),
    T.StructField("CustomerAge", T.IntegerType()),
    T.StructField("CustomerOccupation", T.StringType()),
    T.StructField("TransactionDuration", T.DoubleType()),
    T.StructField("LoginAttempts", T.IntegerType()),
    T.StructField("AccountBalance", T.DoubleType()),
    T.StructField("PreviousTransactionDate", T.TimestampNTZType()),
    T.StructField("FraudFlag", T.StringType()),
    T.StructField("FraudRiskScore", T.DoubleType()),
    T.StructField("Category", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("DeviceID", T.StringType()),
    T.StructField("IP Address", T.StringType()),
    T.StructField("MerchantID", T.StringType()),
])

TRANSACTION_SCHEMA = T.StructType([*TRANSACTION_SCHEMA.fields, *[
    T.StructField(name, T.IntegerType()) for name in ("TransactionDay", "TransactionMonth", "TransactionYear", "TransactionDayOfWeek", "IsWeekend",
                                                      "IsLargeTransaction", "IsCredit")],
    T.StructField("DaysSincePreviousTx", T.LongType()), T.StructField("Date", T.TimestampNTZType())])

SUMMARY_SCHEMA = T.StructType([
    T.StructField("Location", T.StringType()),
    T.StructField("Date", T.DateType()),
    *[T.StructField(name, T.LongType()) for name in ("TransactionCount", "CreditTransactionCount", "LargeTransactionCount", "MaxLoginAttempts")],
    *[T.StructField(name, T.DoubleType()) for name in ("TotalAmount", "AverageAmount", "AmountStdDev", "AverageLoginAttempts",
                                                       "AverageCustomerAge", "AverageTransactionDuration", "FraudRiskScore")],
])

SAMPLE_TYPE = T.ArrayType(T.MapType(T.StringType(), T.StringType()))

ANOMALY_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("entity", T.StringType()),
    T.StructField("event_date", T.StringType()),
    T.StructField("actual_count", T.LongType()),
    T.StructField("expected_count", T.LongType()),
    T.StructField("std_deviation", T.DoubleType()),
    T.StructField("avg_amount", T.DoubleType()),
    T.StructField("top_locations", T.ArrayType(T.StringType())),
    T.StructField("location_distribution", T.MapType(T.StringType(), T.LongType())),
    T.StructField("sample", SAMPLE_TYPE),
    T.StructField("details", T.StringType()),
])

PERFORMANCE_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("response_time_seconds", T.DoubleType()),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("embedding_time_seconds", T.DoubleType()),
    T.StructField("retrieval_time_seconds", T.DoubleType()),
    T.StructField("llm_time_seconds", T.DoubleType()),
])

USAGE_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("tokens_prompt", T.LongType()),
    T.StructField("tokens_completion", T.LongType()),
    T.StructField("tokens_total", T.LongType()),
    T.StructField("estimated_cost_usd", T.DoubleType()),
])

FEEDBACK_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("query_id", T.StringType()),
    T.StructField("alert_quality", T.IntegerType()),
    T.StructField("is_accurate", T.BooleanType()),
    T.StructField("is_actionable", T.BooleanType()),
    T.StructField("user_comments", T.StringType()),
    T.StructField("valid", T.BooleanType()),
])

LOG_SCHEMAS = {
    "performance": PERFORMANCE_LOG_SCHEMA,
    "usage": USAGE_LOG_SCHEMA,
    "feedback": FEEDBACK_LOG_SCHEMA,
}

LINEAGE_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("operation", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("seq", T.LongType()),
])

HISTORY_SCHEMA = T.StructType([
    *LINEAGE_SCHEMA.fields,
    T.StructField("processed_records", T.LongType()),
    T.StructField("processed_files", T.ArrayType(T.StringType())),
    T.StructField("merge_with_existing", T.BooleanType()),
])

VERSION_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("current_version", T.StringType()),
    T.StructField("versions", T.MapType(T.StringType(), T.StructType([
        T.StructField("created_at", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("parent_version", T.StringType()),
        T.StructField("processing_info", T.StructType([
            T.StructField("merge_with_existing", T.BooleanType()),
            T.StructField("processed_records", T.LongType()),
            T.StructField("processed_files", T.ArrayType(T.StringType())),
        ])),
    ]))),
    T.StructField("data_lineage", T.ArrayType(T.StructType([
        T.StructField("version", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]))),
    T.StructField("last_updated", T.StringType()),
])


def pick(df: DataFrame, *names: str) -> str | None:
    """First of ``names`` that is a column of ``df``; decided once, while the plan is built."""
    present = set(df.columns)
    return next((name for name in names if name in present), None)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def existing(df: DataFrame, names: list[str]) -> list[str]:
    present = set(df.columns)
    return [name for name in names if name in present]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def to_anomaly(df: DataFrame) -> DataFrame:
    """Pad a detector's own columns to the common anomaly schema, in order."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ANOMALY_SCHEMA.fields
    ])
