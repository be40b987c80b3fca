"""Row features of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.scalars import age_group, elapsed_days, no_nan
from alertlake.operators.quantiles import quantiles
from alertlake.schema import DATE_COLUMNS, pick, quoted

LARGE_QUANTILE = 0.95


def date_parts(df: DataFrame) -> DataFrame:
    name = pick(df, *DATE_COLUMNS)
    if name is None:
        return df
    ts = quoted(name)
    return df.withColumns({
        "TransactionDay": F.dayofmonth(ts),
        "TransactionMonth": F.month(ts),
        "TransactionYear": F.year(ts),
        "TransactionDayOfWeek": F.weekday(ts),
        "IsWeekend": (F.weekday(ts) >= 5).cast("int"),
    })


def days_since_previous(df: DataFrame) -> DataFrame:
    name = pick(df, *DATE_COLUMNS)
    if name is None or "PreviousTransactionDate" not in df.columns:
        return df
    return df.withColumn("DaysSincePreviousTx", elapsed_days(F.col("PreviousTransactionDate"), quoted(name)))


def large_flag(df: DataFrame, quantile: float = LARGE_QUANTILE, amounts: DataFrame | None = None) -> DataFrame:
    """1 where the amount exceeds the quantile of all amounts. ``amounts`` may name a narrower frame with the same amounts."""
    if "TransactionAmount" not in df.columns:
        return df
    source = (amounts if amounts is not None else df).select("TransactionAmount")
    limit = quantiles(source, {"limit": ("TransactionAmount", quantile)}).scalar()
    return mark_large(df, limit)


def mark_large(df: DataFrame, limit: Column) -> DataFrame:
    return df.withColumn("IsLargeTransaction", F.coalesce(no_nan(F.col("TransactionAmount")) > limit, F.lit(False)).cast("int"))


def credit_flag(df: DataFrame, credit: str = "Credit") -> DataFrame:
    if "TransactionType" not in df.columns:
        return df
    return df.withColumn("IsCredit", F.coalesce(F.col("TransactionType") == credit, F.lit(False)).cast("int"))


def age_bands(df: DataFrame) -> DataFrame:
    if "CustomerAge" not in df.columns:
        return df
    return df.withColumn("AgeGroup", age_group(F.col("CustomerAge")))


def create_features(df: DataFrame, quantile: float = LARGE_QUANTILE, credit: str = "Credit",
                    amounts: DataFrame | None = None) -> DataFrame:
    """All row features; each is skipped when its columns are missing."""
    return row_features(large_flag(df, quantile, amounts), credit)


def row_features(df: DataFrame, credit: str = "Credit") -> DataFrame:
    """The features that need no other row."""
    return age_bands(credit_flag(days_since_previous(date_parts(df)), credit))
