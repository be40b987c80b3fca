"""Sentences for rows, query texts for anomalies, and prompt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.functions.scalars import format_fixed
from alertlake.schema import quoted

# Sentence patterns. {Name} is the column as text, {Name:2} is a number with two decimals.
TRANSACTION_SENTENCE = (
    "Transaction {TransactionID} was a {TransactionAmount:2} {TransactionType} transaction on {TransactionDate} "
    "at {Location} branch via {Channel}. "
    "The customer is {CustomerAge} years old and works as a {CustomerOccupation}. "
    "The transaction took {TransactionDuration} seconds with {LoginAttempts} login attempts. "
    "Account balance after transaction was {AccountBalance:2}."
)
SUMMARY_SENTENCE = (
    "Daily summary for {Location} on {Date}: "
    "Processed {TransactionCount} transactions totaling {TotalAmount:2}. "
    "Average transaction amount was {AverageAmount:2} with standard deviation of {AmountStdDev:2}. "
    "The branch had {CreditTransactionCount} credit transactions and {LargeTransactionCount} large transactions. "
    "Average login attempts were {AverageLoginAttempts:2} with maximum of {MaxLoginAttempts}. "
)
SUMMARY_AGE_SENTENCE = "Average customer age was {AverageCustomerAge:2} years. "
SUMMARY_DURATION_SENTENCE = "Average transaction duration was {AverageTransactionDuration:2} seconds. "
SUMMARY_RISK_SENTENCE = "Fraud risk score: {FraudRiskScore:4}."
DEFAULT_RISK = 0.01
UNKNOWN = "Unknown"

# What to ask for each kind of anomaly.
ANOMALY_QUERIES = {
    "large_transactions": "Generate an alert for {count} unusually large transactions above {threshold:2}",
    "fraud_flags": "Generate an alert for {count} transactions flagged as potential fraud",
    "high_login_attempts": "Generate an alert for {count} transactions with high login attempts above {threshold:0}",
    "overnight_transactions": "Generate an alert for {count} transactions occurring during overnight hours (12am-5am)",
    "velocity_anomaly": "Generate an alert for {count} transactions occurring in rapid succession",
    "high_large_transaction_ratio": "Generate an alert for {count} branches with unusually high ratio of large transactions",
    "unusual_transaction_volume": (
        "Generate an alert for branch {entity} with unusual transaction volume of {actual_count} vs expected {expected_count}"),
}
EXTREME_QUERIES = {
    "_extreme_high": "Generate an alert for unusually high values in {field}",
    "_extreme_low": "Generate an alert for unusually low values in {field}",
}
OTHER_QUERY = "Generate an alert for {type} with severity {severity}"


def fill(pattern: str, columns: dict[str, Column], missing: str | None = None) -> Column:
    """Turn a pattern into one concat over columns; no per-row Python. A NULL column reads as ``missing``, or makes the whole NULL."""
    parts: list[Column] = []
    for i, piece in enumerate(pattern.replace("}", "{").split("{")):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
            continue
        name, _, digits = piece.partition(":")
        column = columns[name]
        shown = F.when(column.isNotNull(), format_fixed(column, int(digits))) if digits else column.cast("string")
        parts.append(shown if missing is None else F.coalesce(shown, F.lit(missing)))
    return F.concat(*parts)


def time_text(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def transaction_text(df: DataFrame) -> Column:
    columns = {c: quoted(c) for c in df.columns}
    columns["TransactionDate"] = time_text(quoted("TransactionDate"))
    return fill(TRANSACTION_SENTENCE, columns, UNKNOWN)


def summary_text(df: DataFrame) -> Column:
    """Missing columns read as zero or 'Unknown'; the age and duration sentences need their columns."""
    present = set(df.columns)
    columns = {}
    for name in ("Location", "Date"):
        value = quoted(name).cast("string") if name in present else F.lit(None).cast("string")
        columns[name] = F.coalesce(value, F.lit(UNKNOWN))
    for name in ("TransactionCount", "TotalAmount", "AverageAmount", "AmountStdDev", "CreditTransactionCount",
                 "LargeTransactionCount", "AverageLoginAttempts", "MaxLoginAttempts", "AverageCustomerAge",
                 "AverageTransactionDuration"):
        columns[name] = F.coalesce(quoted(name), F.lit(0)) if name in present else F.lit(0)
    columns["FraudRiskScore"] = (
        F.coalesce(quoted("FraudRiskScore"), F.lit(DEFAULT_RISK)) if "FraudRiskScore" in present else F.lit(DEFAULT_RISK))
    pattern = SUMMARY_SENTENCE
    if "AverageCustomerAge" in present:
        pattern += SUMMARY_AGE_SENTENCE
    if "AverageTransactionDuration" in present:
        pattern += SUMMARY_DURATION_SENTENCE
    return fill(pattern + SUMMARY_RISK_SENTENCE, columns)


def transaction_metadata() -> Column:
    return F.struct(
        time_text(F.col("TransactionDate")).alias("date"),
        F.col("Location").alias("location"),
        F.col("TransactionType").alias("type"),
        F.col("TransactionAmount").cast("double").alias("amount"),
        F.col("Channel").alias("channel"),
        F.lit(None).cast("bigint").alias("transaction_count"),
        F.lit(None).cast("double").alias("fraud_risk_score"),
    )


def summary_metadata(df: DataFrame) -> Column:
    risk = F.col("FraudRiskScore").cast("double") if "FraudRiskScore" in df.columns else F.lit(None).cast("double")
    return F.struct(
        F.coalesce(F.col("Date").cast("string"), F.lit("")).alias("date"),
        F.coalesce(F.col("Location"), F.lit(UNKNOWN)).alias("location"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("channel"),
        F.coalesce(F.col("TransactionCount").cast("bigint"), F.lit(0)).alias("transaction_count"),
        F.coalesce(risk, F.lit(DEFAULT_RISK)).alias("fraud_risk_score"),
    )


def anomaly_query() -> Column:
    """Query text for an anomaly row."""
    kind = F.col("type")
    columns = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
               ("type", "severity", "count", "entity", "actual_count", "expected_count")}
    columns["threshold"] = F.col("threshold")
    text = fill(OTHER_QUERY, columns)
    for suffix in ("_extreme_low", "_extreme_high"):
        field = {"field": F.replace(kind, F.lit(suffix), F.lit(""))}
        text = F.when(kind.contains(suffix[1:]), fill(EXTREME_QUERIES[suffix], field)).otherwise(text)
    for name, pattern in ANOMALY_QUERIES.items():
        text = F.when(kind == name, fill(pattern, columns)).otherwise(text)
    return text


def usable_text(text: Column, max_chars: int | None = 2000) -> Column:
    """Text cut to the context limit, or whole with None; NULL for blank text."""
    return F.when(text.rlike(r"\S"), text if max_chars is None else F.substring(text, 1, max_chars))


# Prompt wording is this library's own; the placeholders are what the five request kinds supply.
PROMPTS = {
    "general": (
        "Role: analyst for a bank's management reports.\n\nTransaction records:\n{context}\n\n"
        "Request: {query}\n\nWrite one short alert that names the pattern, the evidence and the next step."),
    "branch": (
        "Role: analyst for a bank's management reports.\n\nBranch: {branch}\nPeriod: {time_period}\n\n"
        "Branch records:\n{context}\n\nDescribe how the branch performs and what stands out."),
    "fraud": (
        "Role: analyst of a bank's fraud team.\n\nRecent records:\n{context}\n\n"
        "Judge the fraud risk from amounts, failed logins, places, timing and habits, and say what to check first."),
    "comparison": (
        "Role: analyst for a bank's management reports.\n\nPeriod: {time_period}\n\nFirst branch:\n{branch_a_context}\n\n"
        "Second branch:\n{branch_b_context}\n\nExplain where the two branches differ and why it matters."),
    "trend": (
        "Role: analyst for a bank's management reports.\n\nPeriod: {time_period}\n\nRecords over time:\n{context}\n\n"
        "Describe trends, seasons and sudden changes."),
}


def prompt_text(kind: str, columns: dict[str, Column]) -> Column:
    return fill(PROMPTS[kind], columns)
