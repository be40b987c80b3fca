"""Anomaly detectors.

Rules that judge a row alone are counted together in one pass, whatever their number. A detector returns rows of the common
anomaly schema; the rows behind an anomaly stay a table (``tagged_rows``) and are never gathered into one list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.functions.scalars import elapsed_minutes, format_fixed, hour_in, is_true, no_nan, parse_time
from alertlake.operators.clean import standardise
from alertlake.operators.quantiles import approximate_quantiles, quantiles
from alertlake.operators.skew import MINUTE, NATIVE, slice_window, sliced_with_reach
from alertlake.schema import (DATE_COLUMNS, SAMPLE_BRANCH_COLUMNS, SUMMARY_BRANCH_COLUMNS, existing, numeric_columns, pick,
                              quoted, to_anomaly)


@dataclass(frozen=True)
class Limits:
    """Parameters of the row rules. ``UPLOAD`` judges one new file, ``BATCH`` the processed datasets.

    ``require_time`` leaves rows at exactly midnight, mostly dates without a time, out of the overnight rule.
    ``exact_quantile = False`` trades the exact threshold for one pass with a bounded rank error.
    """

    amount_quantile: float = 0.95
    logins_above: float = 5
    overnight: bool = True
    velocity_minutes: float = 5
    require_time: bool = False
    exact_quantile: bool = True


UPLOAD = Limits()
BATCH = Limits(amount_quantile=0.99, logins_above=3, overnight=False)

RATIO_LIMIT = 0.15
VOLUME_DEVIATIONS = 2
EXTREME_REACH = 3
EXTREME_SHARE = 0.01
SAMPLE_SIZE = 10


@dataclass(frozen=True)
class Rule:
    type: str
    severity: str
    holds: Column
    threshold: Column
    details: Column


def row_rules(df: DataFrame, limits: Limits = UPLOAD, only: list[str] | None = None,
              amounts: DataFrame | None = None) -> list[Rule]:
    """Rules whose columns exist in ``df``. Their ``details`` may refer to the count as column ``n``."""
    n = F.col("n").cast("string")
    none = F.lit(None).cast("double")
    rules: list[Rule] = []

    def wanted(name: str) -> bool:
        return only is None or name in only

    if "TransactionAmount" in df.columns and wanted("large_transactions"):
        source = (amounts if amounts is not None else df).select("TransactionAmount")
        find = quantiles if limits.exact_quantile else approximate_quantiles
        limit = find(source, {"limit": ("TransactionAmount", limits.amount_quantile)}).scalar()
        rules.append(Rule(
            "large_transactions", "medium", no_nan(F.col("TransactionAmount")) > limit, limit,
            F.concat(F.lit("Found "), n, F.lit(" transactions above "), format_fixed(F.col("t")))))
    if "FraudFlag" in df.columns and wanted("fraud_flags"):
        rules.append(Rule("fraud_flags", "high", is_true(F.col("FraudFlag")), none,
                          F.concat(F.lit("Found "), n, F.lit(" transactions flagged as fraudulent"))))
    if "LoginAttempts" in df.columns and wanted("high_login_attempts"):
        above = limits.logins_above
        shown = str(int(above)) if float(above).is_integer() else str(above)
        rules.append(Rule("high_login_attempts", "medium", no_nan(F.col("LoginAttempts")) > above, F.lit(float(above)),
                          F.concat(F.lit("Found "), n, F.lit(f" transactions with login attempts > {shown}"))))
    when = pick(df, *DATE_COLUMNS)
    if limits.overnight and when and wanted("overnight_transactions"):
        ts = event_time(df)
        night = hour_in(ts, 0, 5)
        if limits.require_time:
            night = night & (F.date_trunc("day", ts) != ts)
        rules.append(Rule("overnight_transactions", "medium", night, none,
                          F.concat(F.lit("Found "), n, F.lit(" transactions during overnight hours (12am-5am)"))))
    return rules


def event_time(df: DataFrame) -> Column:
    name = pick(df, *DATE_COLUMNS)
    kind = df.schema[name].dataType
    return quoted(name) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else parse_time(quoted(name))


def count_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules in one aggregation over one scan; rules that match nothing give no row."""
    if not rules:
        return to_anomaly(df.sparkSession.range(0).drop("id"))
    counts = df.agg(*[F.count_if(rule.holds).alias(f"n{i}") for i, rule in enumerate(rules)])
    rows = counts.select(F.explode(F.array(*[
        F.struct(F.lit(rule.type).alias("type"), F.lit(rule.severity).alias("severity"), F.col(f"n{i}").alias("n"),
                 rule.threshold.alias("t"))
        for i, rule in enumerate(rules)
    ])).alias("e")).select("e.*").where(F.col("n") > 0)
    details = F.lit(None).cast("string")
    for rule in rules:
        details = F.when(F.col("type") == rule.type, rule.details).otherwise(details)
    return to_anomaly(rows.select("type", "severity", F.col("n").alias("count"), F.col("t").alias("threshold"),
                                  details.alias("details")))


def tagged_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One output row per input row and rule that holds, with the rule's name in ``anomaly_type``."""
    tags = F.array_compact(F.array(*[F.when(rule.holds, F.lit(rule.type)) for rule in rules]))
    return df.select("*", F.explode(tags).alias("anomaly_type"))


def with_samples(anomalies: DataFrame, tagged: DataFrame, columns: list[str], order: str,
                 size: int = SAMPLE_SIZE) -> DataFrame:
    """Attach the first ``size`` rows of each anomaly. The rank limit is applied before the shuffle as well as after it."""
    rank = F.row_number().over(Window.partitionBy("anomaly_type").orderBy(quoted(order)))
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[quoted(c).cast("string") for c in columns]))
    sample = (
        tagged.select("anomaly_type", quoted(order), *[quoted(c) for c in columns if c != order])
        .withColumn("rank", rank).where(F.col("rank") <= size)
        .groupBy("anomaly_type")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.map_entries(fields).alias("row")))),
                         lambda s: F.map_from_entries(s["row"])).alias("_sample"))
    )
    joined = anomalies.drop("sample").join(sample, anomalies["type"] == sample["anomaly_type"], "left")
    return to_anomaly(joined.withColumnRenamed("_sample", "sample"))


def anomaly_rows(df: DataFrame, rules: list[Rule], limits: Limits = UPLOAD, top: int = 3) -> dict[str, DataFrame]:
    """The rows behind every anomaly of an upload, by its type: of the row ``rules``, those in rapid succession, and those at the top locations."""
    found = {rule.type: df.where(rule.holds) for rule in rules}
    when = pick(df, *DATE_COLUMNS)
    if "CustomerID" in df.columns and when is not None:
        tie = "TransactionID" if "TransactionID" in df.columns else when
        rapid = rapid_rows(df, limits.velocity_minutes, tie).withColumn(when, quoted(when).cast(df.schema[when].dataType))
        found["velocity_anomaly"] = rapid.drop("gap_minutes")
    if "Location" in df.columns:
        best = F.broadcast(top_locations(df, top))  # ``top`` rows
        found["location_insights"] = df.join(best, df["Location"] == best["location"], "left_semi")
    return found


def anomaly_places(df: DataFrame, rules: list[Rule], behind: dict[str, DataFrame]) -> DataFrame:
    """(anomaly_type, Location) once for every location of the rows ``behind`` each anomaly. One pass finds those of all row ``rules``."""
    types = [rule.type for rule in rules]
    found = [rows.select(F.lit(kind).alias("anomaly_type"), "Location").distinct() for kind, rows in behind.items() if kind not in types]
    if rules:
        held = F.array_compact(F.array(*[F.when(F.bool_or(rule.holds), F.lit(rule.type)) for rule in rules]))
        found.append(df.groupBy("Location").agg(held.alias("types")).select(F.explode("types").alias("anomaly_type"), "Location"))
    return union_all(found).where(F.col("Location").isNotNull())


def sample_columns(df: DataFrame, rule: str) -> list[str]:
    if rule == "high_login_attempts":
        return existing(df, ["TransactionID", "LoginAttempts", "CustomerID"])
    branch = pick(df, *SAMPLE_BRANCH_COLUMNS)
    return existing(df, ["TransactionID", "TransactionAmount", "TransactionType"]) + ([branch] if branch else [])


def rapid_rows(df: DataFrame, minutes: float = 5, tie: str = "TransactionID") -> DataFrame:
    """Rows less than ``minutes`` after the same customer's previous row, with that gap."""
    name = pick(df, *DATE_COLUMNS)
    timed = df.withColumn(name, event_time(df)).where(F.col("CustomerID").isNotNull())
    spread = sliced_with_reach(timed, name, int(minutes * MINUTE))
    previous = F.lag(quoted(name)).over(slice_window("CustomerID").orderBy(quoted(name), quoted(tie)))
    return (
        spread.withColumn("gap_minutes", elapsed_minutes(previous, quoted(name)))
        .where(F.col(NATIVE) & (F.col("gap_minutes") < minutes)).drop("_slice", NATIVE)
    )


def velocity(df: DataFrame, limits: Limits = UPLOAD) -> DataFrame:
    if "CustomerID" not in df.columns or pick(df, *DATE_COLUMNS) is None:
        return count_rules(df, [])
    needed = existing(df, ["CustomerID", "TransactionID"]) + [pick(df, *DATE_COLUMNS)]
    tie = "TransactionID" if "TransactionID" in df.columns else pick(df, *DATE_COLUMNS)
    found = rapid_rows(df.select(*[quoted(c) for c in needed]), limits.velocity_minutes, tie)
    counted = found.agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 0)
    shown = f"{limits.velocity_minutes:g}"
    return to_anomaly(counted.withColumns({
        "type": F.lit("velocity_anomaly"), "severity": F.lit("high"),
        "details": F.concat(F.lit("Found "), F.col("count").cast("string"),
                            F.lit(f" transactions occurring in rapid succession (<{shown} min apart)")),
    }))


def location_counts(df: DataFrame, column: str = "Location") -> DataFrame:
    return df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("location")).agg(
        F.count(F.lit(1)).alias("transactions"))


def top_locations(df: DataFrame, k: int, column: str = "Location") -> DataFrame:
    """The k busiest locations, ties by name."""
    return location_counts(df, column).orderBy(F.desc("transactions"), "location").limit(k)


def location_insights(df: DataFrame, top: int = 3, shown: int = 5) -> DataFrame:
    if "Location" not in df.columns:
        return count_rules(df, [])
    # At most ``shown`` rows from here on.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("transactions")).alias("order"), "location", "transactions")))
    packed = top_locations(df, shown).agg(ranked.alias("all")).where(F.size("all") > 0)
    best = F.slice("all", 1, top)
    names = F.transform(best, lambda e: e["location"])
    return to_anomaly(packed.select(
        F.lit("location_insights").alias("type"), F.lit("low").alias("severity"),
        F.aggregate(best, F.lit(0).cast("bigint"), lambda total, e: total + e["transactions"]).alias("count"),
        names.alias("top_locations"),
        F.map_from_entries(F.transform("all", lambda e: F.struct(e["location"], e["transactions"]))).alias("location_distribution"),
        F.concat(F.lit("Top transaction locations: "), F.array_join(names, ", ")).alias("details"),
    ))


def first_locations(df: DataFrame, k: int = 5) -> Column:
    """The first k location names in order, as one array value."""
    names = df.where(F.col("Location").isNotNull()).select("Location").distinct().orderBy("Location").limit(k)
    return names.agg(F.sort_array(F.collect_list("Location"))).scalar()


def overview(df: DataFrame) -> DataFrame:
    """Plain description of a file, for when nothing else was found."""
    has_amount, has_place = "TransactionAmount" in df.columns, "Location" in df.columns
    base = df.agg(
        F.count(F.lit(1)).alias("count"),
        (F.avg(no_nan(F.col("TransactionAmount"))) if has_amount else F.lit(None).cast("double")).alias("avg_amount"),
        (F.count_distinct("Location") if has_place else F.lit(0)).alias("places"),
    ).where(F.col("count") > 0)
    details = F.concat(F.lit("Analyzed "), F.col("count").cast("string"), F.lit(" transactions"))
    if has_amount:
        details = F.concat(details, F.coalesce(
            F.concat(F.lit(" with average amount "), format_fixed(F.col("avg_amount"))), F.lit("")))
    if has_place:
        details = F.concat(details, F.when(
            F.col("places") > 0, F.concat(F.lit(" from "), F.col("places").cast("string"), F.lit(" locations"))).otherwise(""))
    out = base.withColumns({"type": F.lit("transactions_overview"), "severity": F.lit("low"), "details": details})
    if has_place:
        out = out.withColumn("top_locations", first_locations(df))
    if "TransactionID" in df.columns:
        out = out.withColumn("sample", sampled_ids(df))
    return to_anomaly(out)


def sampled_ids(df: DataFrame, size: int = 5) -> Column:
    """A fixed pseudo-random choice of ids, as one array value."""
    few = df.select(F.col("TransactionID").cast("string").alias("id")).orderBy(F.xxhash64("TransactionID"), "id").limit(size)
    ids = few.agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select(F.transform("ids", lambda v: F.create_map(F.lit("TransactionID"), v)).alias("rows")).scalar()


def general_insight(df: DataFrame) -> DataFrame:
    """Row count, mean amount and first locations of a file; always given when it has rows."""
    amount = F.coalesce(F.avg(no_nan(F.col("TransactionAmount"))), F.lit(0.0)) if "TransactionAmount" in df.columns else F.lit(0.0)
    base = df.agg(F.count(F.lit(1)).alias("count"), amount.alias("avg_amount")).where(F.col("count") > 0)
    out = base.withColumns({
        "type": F.lit("general_insight"), "severity": F.lit("low"),
        "details": F.concat(F.lit("Analysis of "), F.col("count").cast("string"), F.lit(" uploaded transaction records")),
    })
    if "Location" in df.columns:
        out = out.withColumn("top_locations", first_locations(df))
    return to_anomaly(out)


def large_ratio_days(summaries: DataFrame, limit: float = RATIO_LIMIT) -> DataFrame:
    ratio = F.try_divide(F.col("LargeTransactionCount"), F.col("TransactionCount"))
    return summaries.withColumn("LargeTransactionRatio", ratio).where(F.col("LargeTransactionRatio") > limit)


def high_large_ratio(summaries: DataFrame, limit: float = RATIO_LIMIT) -> DataFrame:
    if not {"LargeTransactionCount", "TransactionCount"} <= set(summaries.columns):
        return count_rules(summaries, [])
    rule = Rule("high_large_transaction_ratio", "medium",
                F.try_divide(F.col("LargeTransactionCount"), F.col("TransactionCount")) > limit, F.lit(float(limit)),
                F.lit(None).cast("string"))
    return count_rules(summaries, [rule])


def unusual_volume(summaries: DataFrame, deviations: float = VOLUME_DEVIATIONS, date: str = "Date") -> DataFrame:
    """First day per branch whose count lies more than ``deviations`` sample deviations from the branch mean."""
    branch = pick(summaries, *SUMMARY_BRANCH_COLUMNS)
    if branch is None or "TransactionCount" not in summaries.columns:
        return count_rules(summaries, [])
    day = quoted(date).cast("string") if date in summaries.columns else F.lit(None).cast("string")
    rows = summaries.where(quoted(branch).isNotNull()).select(
        quoted(branch).alias("entity"), day.alias("day"), F.col("TransactionCount").alias("x"))
    stats = rows.groupBy("entity").agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(1.0)).alias("spread"))
    outside = rows.join(stats, "entity").where(F.abs(F.col("x") - F.col("mean")) > deviations * F.col("spread"))
    first = outside.groupBy("entity").agg(F.min(F.struct(
        F.col("day").isNull().alias("undated"), "day", "x", "mean", "spread")).alias("f"))
    return to_anomaly(first.select(
        F.lit("unusual_transaction_volume").alias("type"), F.lit("low").alias("severity"), "entity",
        F.coalesce(F.col("f.day"), F.lit("Unknown")).alias("event_date"),
        F.col("f.x").cast("bigint").alias("actual_count"), F.col("f.mean").cast("bigint").alias("expected_count"),
        F.col("f.spread").alias("std_deviation"),
    ))


def flag_columns(df: DataFrame, dataset: str) -> DataFrame:
    """Counts per column whose name says flag or alert: true booleans, positive numbers. Text columns are passed over."""
    rules = []
    for field in df.schema.fields:
        if not any(word in field.name.lower() for word in ("flag", "alert")):
            continue
        if isinstance(field.dataType, T.BooleanType):
            holds = F.coalesce(quoted(field.name), F.lit(False))
        elif isinstance(field.dataType, T.NumericType):
            holds = no_nan(quoted(field.name)) > 0
        else:
            continue
        rules.append(Rule(f"{dataset}_{field.name}", "medium", holds, F.lit(None).cast("double"), F.lit(None).cast("string")))
    return count_rules(df, rules)


def extreme_fences(df: DataFrame, dataset: str, reach: float = EXTREME_REACH, share: float = EXTREME_SHARE) -> DataFrame:
    """Per numeric column and side: fence, rows beyond it and whether that is more than ``share`` of all rows.

    Two passes over the data for any number of columns: one for all quantiles, one for all counts.
    """
    columns = [c for c in numeric_columns(df) if not any(word in c.lower() for word in ("id", "index"))]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "type string, severity string, count bigint, threshold double, fired boolean")
    wanted = {}
    for i, c in enumerate(columns):
        wanted[f"l{i}"], wanted[f"h{i}"] = (c, 0.05), (c, 0.95)
    row = quantiles(df.select(*[quoted(c) for c in columns]), wanted)
    marks = row.select(F.struct(*wanted).alias("marks")).scalar()
    fences = []
    for i, c in enumerate(columns):
        low, high = marks.getField(f"l{i}"), marks.getField(f"h{i}")
        fences.append((f"{dataset}_{c}_extreme_high", high + reach * (high - low), no_nan(quoted(c)) > high + reach * (high - low)))
        fences.append((f"{dataset}_{c}_extreme_low", low - reach * (high - low), no_nan(quoted(c)) < low - reach * (high - low)))
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(cond).alias(f"n{i}") for i, (_, _, cond) in enumerate(fences)])
    entries = [
        F.struct(F.lit(name).alias("type"), F.lit("low").alias("severity"), F.col(f"n{i}").alias("count"),
                 fence.alias("threshold"), (F.col(f"n{i}") > F.col("total") * share).alias("fired"))
        for i, (name, fence, _) in enumerate(fences)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def extremes(df: DataFrame, dataset: str) -> DataFrame:
    return to_anomaly(extreme_fences(df, dataset).where("fired").drop("fired"))


Detector = Callable[[DataFrame], DataFrame]
_REGISTRY: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    """Add a rule of one's own: a function from transactions to anomaly rows."""
    _REGISTRY[name] = detector


def unregister_detector(name: str) -> None:
    _REGISTRY.pop(name, None)


def registered_detectors() -> dict[str, Detector]:
    return dict(_REGISTRY)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def detect_upload(df: DataFrame, limits: Limits = UPLOAD, amounts: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """All detectors for one new file, with the overview when nothing else fires.

    Any row with a location gives a location insight, so one look for such a row (a job that stops at the first) settles that
    no overview is needed and spares its scans. Give it a table, not an unwritten aggregate, so that this job stays short.
    """
    rules = row_rules(df, limits, amounts=amounts) if rules is None else rules
    found = [count_rules(df, rules), velocity(df, limits), location_insights(df)]
    found += [to_anomaly(detector(df)) for detector in _REGISTRY.values()]
    if "Location" in df.columns and not df.where(F.col("Location").isNotNull()).select("Location").limit(1).isEmpty():
        return union_all(found)
    everything = union_all([*found, overview(df)])
    # A row per rule, so one task holds them all.
    others = F.count_if(F.col("type") != "transactions_overview").over(Window.partitionBy())
    return everything.withColumn("_others", others).where(
        (F.col("type") != "transactions_overview") | (F.col("_others") == 0)).drop("_others")


def detect_datasets(datasets: dict[str, DataFrame], limits: Limits = BATCH, on: str = "raw") -> DataFrame:
    """Batch detection over processed datasets: transactions, branch summaries, and any other table.

    With ``on="zscore"`` amounts and login attempts are standardised before the transaction rules judge them.
    """
    if on not in ("raw", "zscore"):
        raise ValueError("on must be raw or zscore")
    found: list[DataFrame] = []
    # Names under which the transactions may be stored.
    known = ("transactions", "bank_transactions_data_2", "branch_summaries")
    transactions = datasets.get("transactions", datasets.get("bank_transactions_data_2"))
    if transactions is not None and on == "zscore":
        transactions = standardise(transactions, existing(transactions, ["TransactionAmount", "LoginAttempts"]))
    if transactions is not None:
        rules = row_rules(transactions, limits)
        counted = count_rules(transactions, rules)
        if "TransactionID" in transactions.columns and rules:
            columns = list(dict.fromkeys(c for rule in rules for c in sample_columns(transactions, rule.type)))
            counted = with_samples(counted, tagged_rows(transactions, rules), columns, "TransactionID")
        found.append(counted)
    if "branch_summaries" in datasets:
        found += [high_large_ratio(datasets["branch_summaries"]), unusual_volume(datasets["branch_summaries"])]
    for name, df in datasets.items():
        if name not in known:
            found += [flag_columns(df, name), extremes(df, name)]
    if not found:
        raise ValueError("no dataset to analyse")
    return union_all(found)
