"""Transaction-pattern rules per customer.

Limits are parameters; the defaults are those of the planted fixture patterns. Rules that look back a bounded time use time
slices, rules about a customer as a whole use aggregates, so no rule needs a customer's full history in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.scalars import no_nan
from alertlake.operators.skew import HOUR, MINUTE, NATIVE, SLICE, micros, slice_window, sliced_with_reach
from alertlake.schema import DATE_COLUMNS, pick, quoted


def _time(df: DataFrame) -> str:
    return pick(df, *DATE_COLUMNS)


def _own(spread: DataFrame, condition) -> DataFrame:
    return spread.where(F.col(NATIVE) & condition).drop(NATIVE, SLICE, "_us")


def night_activity(df: DataFrame, first_hour: int = 1, last_hour: int = 4, at_least: int = 3) -> DataFrame:
    hour = F.hour(quoted(_time(df)))
    return (
        df.where(F.col("CustomerID").isNotNull() & hour.between(first_hour, last_hour))
        .groupBy("CustomerID").agg(F.count(F.lit(1)).alias("night_count")).where(F.col("night_count") >= at_least)
    )


def bursts(df: DataFrame, at_least: int = 4, minutes: float = 15) -> DataFrame:
    """Rows that complete ``at_least`` rows of the customer within ``minutes`` before them, both ends included."""
    reach = int(minutes * MINUTE)
    spread = sliced_with_reach(df.where(F.col("CustomerID").isNotNull()), _time(df), reach).withColumn("_us", micros(_time(df)))
    frame = slice_window("CustomerID").orderBy("_us").rangeBetween(-reach, 0)
    return _own(spread.withColumn("burst_count", F.count(F.lit(1)).over(frame)), F.col("burst_count") >= at_least)


def structuring(df: DataFrame, limit: float = 10_000, share: float = 0.975, at_least: int = 3) -> DataFrame:
    """Customers with several amounts just under a reporting limit."""
    amount = no_nan(F.col("TransactionAmount"))
    return (
        df.where(F.col("CustomerID").isNotNull() & (amount >= limit * share) & (amount < limit))
        .groupBy("CustomerID").agg(F.count(F.lit(1)).alias("near_limit_count"), F.sum("TransactionAmount").alias("near_limit_total"))
        .where(F.col("near_limit_count") >= at_least)
    )


def round_amounts(df: DataFrame, unit: float = 1000, at_least: int = 3, whole_part: bool = False) -> DataFrame:
    """Customers with several amounts that are multiples of ``unit``; ``whole_part`` ignores the decimals."""
    amount = no_nan(F.col("TransactionAmount"))
    amount = F.floor(amount) if whole_part else amount
    return (
        df.where(F.col("CustomerID").isNotNull() & (amount >= unit) & (amount % unit == 0))
        .groupBy("CustomerID").agg(F.count(F.lit(1)).alias("round_count")).where(F.col("round_count") >= at_least)
    )


def location_jumps(df: DataFrame, hours: float = 6, tie: str = "TransactionID") -> DataFrame:
    """Rows at another place than the customer's previous row, at most ``hours`` later."""
    name, reach = _time(df), int(hours * HOUR)
    spread = sliced_with_reach(df.where(F.col("CustomerID").isNotNull()), name, reach).withColumn("_us", micros(name))
    order = slice_window("CustomerID").orderBy("_us", quoted(tie))
    moved = spread.withColumns({
        "previous_location": F.lag("Location").over(order),
        "hours_since": (F.col("_us") - F.lag("_us").over(order)) / F.lit(float(HOUR)),
    })
    return _own(moved, (F.col("previous_location") != F.col("Location")) & (F.col("hours_since") <= hours))


def large_first(df: DataFrame, at_least: float = 15_000, tie: str = "TransactionID") -> DataFrame:
    """Customers whose first transaction is large. The first row is a minimum, which combines before the shuffle."""
    first = F.min(F.struct(quoted(_time(df)).alias("at"), quoted(tie).alias("id"), F.col("TransactionAmount").alias("amount")))
    return (
        df.where(F.col("CustomerID").isNotNull() & quoted(_time(df)).isNotNull())
        .groupBy("CustomerID").agg(first.alias("f"))
        .select("CustomerID", F.col("f.id").alias("TransactionID"), F.col("f.at").alias("first_date"),
                F.col("f.amount").alias("first_amount"))
        .where(F.col("first_amount") >= at_least)
    )


def session_extremes(df: DataFrame, logins: float = 30, duration: float = 300) -> DataFrame:
    condition = F.lit(False)
    for name, limit in (("LoginAttempts", logins), ("TransactionDuration", duration)):
        if name in df.columns:
            condition = condition | F.coalesce(no_nan(F.col(name)) >= limit, F.lit(False))
    return df.where(condition)


def cross_border(df: DataFrame, places: list[str], at_least: float = 50_000) -> DataFrame:
    """High amounts at listed places. The list is a short parameter, so it becomes a pushed-down IN filter."""
    return df.where(F.col("Location").isin(places) & (no_nan(F.col("TransactionAmount")) >= at_least))


def takeovers(df: DataFrame, tiny: float = 5, large: float = 8_000, at_least: int = 2, hours: float = 24) -> DataFrame:
    """Large amounts with at least ``at_least`` tiny ones of the same customer in the ``hours`` before them."""
    name, reach = _time(df), int(hours * HOUR)
    amount = no_nan(F.col("TransactionAmount"))
    relevant = df.where(F.col("CustomerID").isNotNull() & ((amount <= tiny) | (amount >= large)))
    spread = sliced_with_reach(relevant, name, reach).withColumn("_us", micros(name))
    frame = slice_window("CustomerID").orderBy("_us").rangeBetween(-reach, -1)
    counted = spread.withColumn("tiny_before", F.count_if(amount <= tiny).over(frame))
    return _own(counted, (amount >= large) & (F.col("tiny_before") >= at_least))


def customer_deviations(df: DataFrame, deviations: float = 2) -> DataFrame:
    """Rows far from the customer's own mean, in sample standard deviations.

    The statistics have one row per customer and are joined back; adaptive execution broadcasts them when small and splits
    the partitions of very busy customers otherwise.
    """
    amount = no_nan(F.col("TransactionAmount"))
    rows = df.where(F.col("CustomerID").isNotNull() & amount.isNotNull())
    stats = rows.groupBy("CustomerID").agg(F.avg(amount).alias("_mean"), F.stddev_samp(amount).alias("_spread"))
    z = F.try_divide(amount - F.col("_mean"), F.col("_spread"))
    return rows.join(stats, "CustomerID").withColumn("customer_z", z).where(F.abs("customer_z") > deviations).drop("_mean", "_spread")
