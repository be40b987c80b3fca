"""Alert records: gate, text, numbering, related rows, and the views a reader of alerts asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.functions.text import anomaly_query
from alertlake.operators import detectors as D
from alertlake.schema import SAMPLE_TYPE, existing, quoted

# Texts of an alert that no model has written.
BASIC_ACTIONS = ["Review the anomaly details", "Investigate transactions"]
UNREADABLE_ACTIONS = [
    "Review the alert details", "Investigate related transactions", "Consider updating monitoring rules"]
CUSTOM_TITLE = "Custom Alert"
CUSTOM_DESCRIPTION = "No description available"
FIRST_LINE_FALLBACK = "Alert Generated"
SEVERITY_RANKS = {"high": 0, "medium": 1, "low": 2}
UNKNOWN_RANK = 99
NO_TIME = "2000-01-01 00:00:00"
FRAUD_KINDS = ["fraud_flags", "high_login_attempts", "velocity_anomaly"]
NOT_GENERAL = ["fraud_flags", "high_login_attempts"]
GATE = 0.5


def severity_rank(severity: Column) -> Column:
    rank = F.lit(UNKNOWN_RANK)
    for name, number in SEVERITY_RANKS.items():
        rank = F.when(F.coalesce(severity, F.lit("low")) == name, number).otherwise(rank)
    return rank


def gate(anomalies: DataFrame, alert_threshold: float = 0.7) -> DataFrame:
    """Low severity passes only at thresholds up to 0.5."""
    return anomalies.where(F.col("severity") != "low") if alert_threshold > GATE else anomalies


def run_time(run_id: str) -> Column:
    """The moment a run id starts with, as yyyyMMddHHmmss; NULL for ids that name no time."""
    return F.try_to_timestamp(F.lit(run_id[:14]), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def basic_alerts(anomalies: DataFrame, run_id: str, alert_threshold: float = 0.7, behind: DataFrame | None = None) -> DataFrame:
    """Alert records with the fixed texts, numbered over severity, type and entity. ``behind`` (see ``related``) gives each alert the
    first rows of its anomaly and the places of all of them.

    Anomalies are aggregates, a row per rule plus at most one per branch, so one task can number them. One window also keeps
    the detectors from running twice, as counting groups beforehand would.
    """
    order = [severity_rank(F.col("severity")), F.col("type"), F.col("entity").asc_nulls_first()]
    numbered = gate(anomalies, alert_threshold).withColumn("_number", F.row_number().over(Window.orderBy(*order)))
    if behind is not None:  # a row per type on both sides
        numbered = numbered.join(behind.select(F.col("anomaly_type").alias("type"), "related", "location_info"), "type", "left")
    number = F.col("_number").cast("string")
    return numbered.select(
        F.concat(F.lit("alert_"), number, F.lit("_" + run_id)).alias("id"),
        F.lit(run_id).alias("run_id"),
        "type", "severity",
        F.lit("new").alias("status"),
        run_time(run_id).alias("timestamp"),
        F.concat(F.lit("Alert: "), F.col("type")).alias("title"),
        F.concat(F.lit("Anomaly detected of type "), F.col("type"), F.lit(" with severity "), F.col("severity")).alias("description"),
        F.array(*[F.lit(a) for a in BASIC_ACTIONS]).alias("recommended_actions"),
        anomaly_query().alias("query"),
        F.struct(*[F.col(c) for c in anomalies.columns]).alias("anomaly"),
        *([F.col("related"), F.col("location_info")] if behind is not None else
          [F.lit(None).cast(SAMPLE_TYPE).alias("related"), F.lit(None).cast("string").alias("location_info")]),
    )


def custom_alerts(requests: DataFrame, run_id: str) -> DataFrame:
    """Alerts for questions asked ad hoc; ``requests`` has query and optionally title, description, recommended_actions."""
    def given(name: str, default: Column) -> Column:
        return F.coalesce(quoted(name), default) if name in requests.columns else default

    return requests.select(
        F.concat(F.lit("custom_" + run_id + "_"), F.sha2("query", 256).substr(1, 16)).alias("id"),
        F.lit(run_id).alias("run_id"), F.lit("custom_query").alias("type"), F.lit("medium").alias("severity"),
        F.lit("new").alias("status"),
        run_time(run_id).alias("timestamp"),
        given("title", F.lit(CUSTOM_TITLE)).alias("title"),
        given("description", F.lit(CUSTOM_DESCRIPTION)).alias("description"),
        given("recommended_actions", F.array().cast("array<string>")).alias("recommended_actions"),
        F.col("query"),
    )


def anomaly_json(anomalies: DataFrame) -> DataFrame:
    """The query text with the anomaly as JSON context below it; unused fields are left out."""
    body = F.to_json(F.struct(*[F.col(c) for c in anomalies.columns]))
    return anomalies.select("type", "entity", F.concat(anomaly_query(), F.lit("\n\nContext: "), body).alias("augmented_query"))


def related(behind: dict[str, DataFrame], places: DataFrame | None, columns: list[str], order: str, size: int = 5) -> DataFrame:
    """Per anomaly type, from the rows behind each: the first ``size`` of them and the names of all their locations, given by ``places``.

    Tasks keep the first rows of each type while they read, so that nothing is sorted, however many rows are behind an anomaly.
    Locations are distinct before they are gathered, so a list is as long as the number of branches. A row is a map of the
    columns as text, so that alerts of tables with other columns still go into one table.
    """
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[quoted(c).cast("string") for c in columns]))
    rank = F.row_number().over(Window.partitionBy("anomaly_type").orderBy(quoted(order)))
    first = (
        D.union_all([rows.select(F.lit(kind).alias("anomaly_type"), *[quoted(c) for c in columns]).orderBy(quoted(order)).limit(size)
                     for kind, rows in behind.items()])
        .withColumn("rank", rank)
        .groupBy("anomaly_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.map_entries(fields).alias("row")))),
                                                 lambda s: F.map_from_entries(s["row"])).alias("related"))
    )
    if places is None:
        return first.withColumn("location_info", F.lit(None).cast("string"))
    named = places.groupBy("anomaly_type").agg(F.concat(
        F.lit(" at "), F.array_join(F.sort_array(F.collect_list("Location")), ", ")).alias("location_info"))
    return first.join(named, "anomaly_type", "left")


def related_rows(df: DataFrame, limits: D.Limits = D.UPLOAD, size: int = 5, rules: list[D.Rule] | None = None) -> DataFrame | None:
    """``related`` for every anomaly of an upload that has rows behind it; None for a table without ids.

    ``rules`` may be given if they are known, as finding the limit of large amounts takes some passes.
    """
    if "TransactionID" not in df.columns:
        return None
    rules = D.row_rules(df, limits) if rules is None else rules
    columns = existing(df, ["TransactionID", "CustomerID", "TransactionAmount", "Location"])
    behind = D.anomaly_rows(df, rules, limits) or {"": df.where(F.lit(False))}
    places = D.anomaly_places(df, rules, behind) if "Location" in df.columns else None
    return related(behind, places, columns, "TransactionID", size)


def by_severity(alerts: DataFrame, severities: list[str]) -> DataFrame:
    return alerts.where(F.col("severity").isin(severities))


def ranked(alerts: DataFrame) -> DataFrame:
    """Sorted by severity, then time; an unknown severity comes last, a missing time counts as 2000-01-01."""
    time = F.coalesce(F.col("timestamp").cast("timestamp_ntz"), F.lit(NO_TIME).cast("timestamp_ntz"))
    return alerts.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", time, "id")


def headlines(alerts: DataFrame) -> DataFrame:
    """First alert of the fraud class and of the general class; an alert may head both."""
    order = [severity_rank(F.col("severity")), F.col("timestamp"), F.col("id")]
    fraud, general = F.col("type").isin(FRAUD_KINDS), ~F.col("type").isin(NOT_GENERAL)
    heads = F.array_compact(F.array(F.when(fraud, F.lit("fraud")), F.when(general, F.lit("general"))))
    rank = F.row_number().over(Window.partitionBy("headline").orderBy(*order))
    return alerts.withColumn("headline", F.explode(heads)).withColumn("_r", rank).where(F.col("_r") == 1).drop("_r")


RESPONSE_TYPE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("recommended_actions", T.ArrayType(T.StringType())),
])


def parse_responses(df: DataFrame, text: str = "response") -> DataFrame:
    """Model replies to alert fields. Text that is no JSON object gives its first line as title and itself as description."""
    reply = F.col(text)
    parsed = F.from_json(reply, RESPONSE_TYPE)
    readable = reply.rlike(r"^\s*\{") & F.json_object_keys(F.when(reply.rlike(r"^\s*\{"), reply)).isNotNull()
    lines = F.filter(F.split(F.trim(reply), "\n"), lambda line: line.rlike(r"\S"))
    first_line = F.coalesce(F.get(lines, F.lit(0)), F.lit(FIRST_LINE_FALLBACK))
    return df.withColumn("_p", parsed).withColumn("_ok", F.coalesce(readable, F.lit(False))).withColumns({
        "title": F.when(F.col("_ok"), F.col("_p.title")).otherwise(F.substring(first_line, 1, 100)),
        "description": F.when(F.col("_ok"), F.col("_p.description")).otherwise(reply),
        "recommended_actions": F.when(F.col("_ok"), F.col("_p.recommended_actions")).otherwise(
            F.array(*[F.lit(a) for a in UNREADABLE_ACTIONS])),
    }).drop("_p", "_ok")


def pattern_tags(df: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(TransactionID, anomaly_type) of pattern rules by name. A rule that finds customers tags all of their transactions."""
    tags = []
    for name, rows in found.items():
        if "TransactionID" not in rows.columns:
            rows = df.join(rows.select("CustomerID").distinct(), "CustomerID", "left_semi")
        tags.append(rows.select("TransactionID", F.lit(name).alias("anomaly_type")))
    return D.union_all(tags)


def investigate(df: DataFrame, tagged: DataFrame | list[DataFrame], ids: DataFrame) -> DataFrame:
    """The asked-for transactions with every rule they break. ``ids`` has TransactionID; ``tagged`` may be several tables of tags."""
    wanted = ids.select("TransactionID").distinct()
    frames = tagged if isinstance(tagged, list) else [tagged]
    tags = (
        D.union_all([t.join(wanted, "TransactionID", "left_semi").select("TransactionID", "anomaly_type") for t in frames]).distinct()
        .groupBy("TransactionID").agg(F.sort_array(F.collect_list("anomaly_type")).alias("broken_rules"))
    )
    rows = df.join(wanted, "TransactionID", "left_semi").join(tags, "TransactionID", "left")
    return rows.withColumn("broken_rules", F.coalesce("broken_rules", F.array().cast("array<string>")))
