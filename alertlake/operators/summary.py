"""Branch summaries, trends, comparisons and period reports. Every aggregate combines map-side before its one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.scalars import percent_change, report_label
from alertlake.operators.quantiles import quantiles
from alertlake.schema import DATE_COLUMNS, pick, quoted

PERIODS = ("day", "week", "month", "quarter", "year")


def _measures(df: DataFrame) -> list[Column]:
    amount = F.col("TransactionAmount")
    measures = [
        F.count(F.lit(1)).alias("TransactionCount"),
        F.sum(amount).alias("TotalAmount"),
        F.avg(amount).alias("AverageAmount"),
        F.stddev_samp(amount).alias("AmountStdDev"),
    ]
    optional = {
        "CreditTransactionCount": ("IsCredit", lambda c: F.sum(c).cast("bigint")),
        "LargeTransactionCount": ("IsLargeTransaction", lambda c: F.sum(c).cast("bigint")),
        "AverageLoginAttempts": ("LoginAttempts", F.avg),
        "MaxLoginAttempts": ("LoginAttempts", F.max),
        "AverageCustomerAge": ("CustomerAge", F.avg),
        "AverageTransactionDuration": ("TransactionDuration", F.avg),
        "FraudRiskScore": ("FraudRiskScore", F.avg),
    }
    measures += [build(F.col(source)).alias(name) for name, (source, build) in optional.items() if source in df.columns]
    return measures


def _keyed(df: DataFrame) -> DataFrame:
    day = F.to_date(quoted(pick(df, *DATE_COLUMNS)))
    branch = quoted(pick(df, "Location", "BranchID"))
    keyed = df.withColumns({"_branch": branch, "_day": day})
    return keyed.where(F.col("_branch").isNotNull() & F.col("_day").isNotNull())


def daily_summaries(df: DataFrame) -> DataFrame:
    """One row per branch and date."""
    keyed = _keyed(df)
    return keyed.groupBy(F.col("_branch").alias("Location"), F.col("_day").alias("Date")).agg(*_measures(df))


def summary_levels(df: DataFrame) -> DataFrame:
    """Rows per branch and date, per branch and overall, marked by ``Level``."""
    keyed = _keyed(df).withColumns({"Location": F.col("_branch"), "Date": F.col("_day")})
    grouped = keyed.groupingSets([["Location", "Date"], ["Location"], []], "Location", "Date")
    out = grouped.agg(*_measures(df), F.grouping_id().alias("_level"))
    level = F.when(F.col("_level") == 0, "branch_date").when(F.col("_level") == 1, "branch").otherwise("all")
    return out.withColumn("Level", level).drop("_level")


def branch_list(df: DataFrame) -> DataFrame:
    branch = quoted(pick(df, "Location", "BranchID"))
    return df.where(branch.isNotNull()).select(branch.alias("branch")).distinct()


def branch_trend(df: DataFrame, period: str) -> DataFrame:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    return branch_trends(df, (period,)).drop("period")


def branch_trends(df: DataFrame, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """Trends over several periods from one aggregation by day: a day's sums are rolled up to every period that holds it."""
    days = _keyed(df).groupBy("_branch", "_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("TransactionAmount").alias("s"), F.count("TransactionAmount").alias("k"))
    starts = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(p, F.col("_day"))).alias("start")) for p in periods]))
    rolled = days.select("_branch", "n", "s", "k", starts.alias("p")).groupBy(
        F.col("p.period").alias("period"), F.col("_branch").alias("branch"), F.col("p.start").alias("period_start"))
    return rolled.agg(F.sum("n").alias("transactions"), F.sum("s").alias("total_amount"),
                      (F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("average_amount"))


def compare_branches(df: DataFrame, first: str, second: str, period: str = "month") -> DataFrame:
    """Both branches side by side per period, with differences. The branch filter runs before the shuffle."""
    branch = quoted(pick(df, "Location", "BranchID"))
    trend = branch_trend(df.where(branch.isin(first, second)), period)
    side = F.when(F.col("branch") == first, "a").otherwise("b")
    wide = (
        trend.withColumn("side", side).groupBy("period_start").pivot("side", ["a", "b"])
        .agg(F.first("transactions").alias("transactions"), F.first("total_amount").alias("total"))
    )
    return wide.withColumns({
        "transactions_difference": F.coalesce(F.col("a_transactions"), F.lit(0)) - F.coalesce(F.col("b_transactions"), F.lit(0)),
        "total_difference": F.coalesce(F.col("a_total"), F.lit(0.0)) - F.coalesce(F.col("b_total"), F.lit(0.0)),
    })


def of_branch(df: DataFrame, branch: str) -> DataFrame:
    return df.where(quoted(pick(df, "Location", "BranchID")) == branch)


def branch_overview(df: DataFrame, branch: str, alerts: DataFrame | None = None) -> DataFrame:
    """The branch's own summary row, and with ``alerts`` (alert records or anomalies of the branch) their number by type."""
    column = pick(df, "Location", "BranchID")
    row = of_branch(df, branch).groupBy(quoted(column).alias("Location")).agg(
        *_measures(df), F.min(quoted(pick(df, *DATE_COLUMNS))).alias("FirstSeen"),
        F.max(quoted(pick(df, *DATE_COLUMNS))).alias("LastSeen"))
    if alerts is None:
        return row
    by_type = alerts.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    counted = by_type.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("m"))  # a row per rule
    return row.withColumn("alerts", counted.scalar())


def weekly_report(df: DataFrame, complaint: Column, large_quantile: float = 0.95,
                  amounts: DataFrame | None = None) -> DataFrame:
    """Branch by week: revenue, transactions, complaints, flags for large amounts."""
    source = (amounts if amounts is not None else df).select("TransactionAmount")
    limit = quantiles(source, {"limit": ("TransactionAmount", large_quantile)}).scalar()
    keyed = _keyed(df).withColumn("_complaint", complaint)
    week = F.to_date(F.date_trunc("week", F.col("_day")))
    return keyed.groupBy(F.col("_branch").alias("branch"), week.alias("week")).agg(
        F.sum("TransactionAmount").alias("revenue"),
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(F.col("_complaint")).alias("complaints"),
        F.count_if(F.col("TransactionAmount") > limit).alias("fraud_flags"),
    )


def period_change(report: DataFrame, value: str, by: str = "branch", period: str = "week") -> DataFrame:
    """Change in percent against the branch's previous period, two decimals; NULL for the first.

    ``report`` holds one row per branch and period, so a branch's window is as long as its calendar.
    """
    previous = F.lag(quoted(value)).over(Window.partitionBy(quoted(by)).orderBy(quoted(period)))
    return report.withColumn(f"previous_{value}", previous).withColumn(
        f"{value}_change_pct", F.round(percent_change(F.col(f"previous_{value}"), quoted(value)), 2))


def label_report(report: DataFrame, change: str = "revenue_change_pct", complaints: str = "complaints",
                 uptime: str = "atm_uptime_percent", flags: str = "fraud_flags") -> DataFrame:
    available = F.col(uptime) if uptime in report.columns else F.lit(None).cast("double")
    return report.withColumn("alert_summary", report_label(F.col(change), F.col(complaints), available, F.col(flags)))


def breaches(timeline: DataFrame, threshold: int = 30) -> DataFrame:
    """Days whose alert count exceeds the threshold."""
    return timeline.where(F.col("alert_count") > threshold).select(
        "date", "month", "alert_count", F.lit(threshold).cast("bigint").alias("threshold"))
