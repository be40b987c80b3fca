"""What a growing history is summed up by, so that new rows don't ask for the old ones again.

A part of the history keeps, beside its rows: moments per branch and day, which merge; a KLL sketch of its amounts; and its tail, the rows
(branch, day, amount) whose amount is at least the sketch's ninth decile. A version keeps the merged moments of its parts. The limit of large
amounts is a high quantile, so its rank lies among the tails: the merged sketches say from where on to look, one exact pass over those few amounts
finds it, and the amounts above it are counted from the tails. If the sketches' guess misses, the whole tails are searched; if the rank lies below
them, the caller has to look at the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators.quantiles import quantiles
from alertlake.schema import quoted

#: Amounts from this share of a part on are its tail; the sketches' size; how far below the rank their guess starts (their error is far less).
TAIL, SKETCH, MARGIN = 0.9, 2000, 0.005
AMOUNT = "TransactionAmount"
#: Averages of these columns are kept as a sum and a count.
AVERAGES = {"LoginAttempts": "AverageLoginAttempts", "CustomerAge": "AverageCustomerAge", "TransactionDuration": "AverageTransactionDuration",
            "FraudRiskScore": "FraudRiskScore"}


def keyed(rows: DataFrame, branch: str, day: str) -> DataFrame:
    return rows.withColumns({"_branch": quoted(branch), "_day": F.to_date(quoted(day))})


def daily_states(rows: DataFrame, branch: str, day: str) -> DataFrame:
    """Moments of the rows of every branch and day, as far as the columns go."""
    amount = F.col(AMOUNT).cast("double")
    states = [F.count(F.lit(1)).alias("n"), F.count(amount).alias("a_n"), F.sum(amount).alias("a_sum"), F.avg(amount).alias("a_mean"),
              (F.var_pop(amount) * F.count(amount)).alias("a_m2")]
    if "IsCredit" in rows.columns:
        states.append(F.sum("IsCredit").cast("bigint").alias("credit"))
    for column in AVERAGES:
        if column in rows.columns:
            states += [F.sum(F.col(column).cast("double")).alias(f"{column}_sum"), F.count(column).alias(f"{column}_n")]
    if "LoginAttempts" in rows.columns:
        states.append(F.max("LoginAttempts").alias("login_max"))
    found = keyed(rows, branch, day).where(F.col("_branch").isNotNull() & F.col("_day").isNotNull())
    return found.groupBy(F.col("_branch").alias("Location"), F.col("_day").alias("Date")).agg(*states)


def _joined(states: Column) -> Column:
    """Count, mean and sum of squared deviations of several of these together."""
    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(states, none, add)


def merge_states(states: list[DataFrame]) -> DataFrame:
    """One state per branch and day. Each of the tables has at most one, so no list is longer than the tables are many."""
    together = states[0]
    for more in states[1:]:
        together = together.unionByName(more, allowMissingColumns=True)
    rest = [c for c in together.columns if c not in ("Location", "Date", "a_mean", "a_m2", "login_max")]
    parts = F.struct(F.col("a_n").alias("n"), F.coalesce("a_mean", F.lit(0.0)).alias("mean"), F.coalesce("a_m2", F.lit(0.0)).alias("m2"))
    merged = together.groupBy("Location", "Date").agg(
        *[F.sum(c).alias(c) for c in rest], F.collect_list(parts).alias("_parts"), *([F.max("login_max").alias("login_max")] if "login_max" in together.columns else []))
    joined = merged.withColumn("_joined", _joined(F.col("_parts")))
    kept = ["login_max"] if "login_max" in together.columns else []
    return joined.select("Location", "Date", *rest, F.col("_joined.mean").alias("a_mean"), F.col("_joined.m2").alias("a_m2"), *kept)


def summaries_of(states: DataFrame, large: DataFrame) -> DataFrame:
    """Daily summaries from states and from (Location, Date, large), the counts of large amounts."""
    n = F.nullif(F.col("a_n"), F.lit(0))
    columns = [F.col("n").alias("TransactionCount"), F.col("a_sum").alias("TotalAmount"), (F.col("a_sum") / n).alias("AverageAmount"),
               F.when(F.col("a_n") > 1, F.sqrt(F.col("a_m2") / (F.col("a_n") - 1))).alias("AmountStdDev")]
    if "credit" in states.columns:
        columns.append(F.col("credit").alias("CreditTransactionCount"))
    columns.append(F.coalesce("large", F.lit(0)).cast("bigint").alias("LargeTransactionCount"))
    for column, name in AVERAGES.items():
        if f"{column}_sum" in states.columns:
            columns.append((F.col(f"{column}_sum") / F.nullif(F.col(f"{column}_n"), F.lit(0))).alias(name))
            if column == "LoginAttempts":
                columns.append(F.col("login_max").alias("MaxLoginAttempts"))
    return states.join(large, ["Location", "Date"], "left").select("Location", "Date", *columns)


def _path(part: str, name: str) -> str:
    return f"{part.rstrip('/').rsplit('/', 1)[0]}/{name}.parquet"


def save_part(rows: DataFrame, part: str, branch: str, day: str, tail: float = TAIL) -> None:
    """Write what a part keeps beside its rows: a row with count, sketch and start of the tail, and the tail itself."""
    spark, amount = rows.sparkSession, F.col(AMOUNT).cast("double")
    sketched = rows.agg(F.count(amount).alias("n"), F.kll_sketch_agg_double(amount, SKETCH).alias("sketch"))
    start = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(tail)))
    sketched.select("n", "sketch", start.alias("start"), F.lit(branch).alias("branch"), F.lit(day).alias("day")).write.parquet(_path(part, "amounts"))
    start = spark.read.parquet(_path(part, "amounts")).first()["start"]
    if start is not None:
        kept = keyed(rows, branch, day).where(amount >= start)
        kept.select(F.col("_branch").alias("Location"), F.col("_day").alias("Date"), amount.alias(AMOUNT)).write.parquet(_path(part, "tail"))


def part_columns(spark: SparkSession, parts: list[str]) -> set[tuple[str, str]]:
    """The columns for branch and day by which the parts were summed up."""
    return {(r["branch"], r["day"]) for p in parts for r in spark.read.parquet(_path(p, "amounts")).select("branch", "day").collect()}


def tail_limit(spark: SparkSession, parts: list[str], quantile: float, margin: float = MARGIN) -> tuple[DataFrame, DataFrame] | None:
    """(one row with the exact quantile of all amounts as ``limit``, the tails), or None if it doesn't lie among the tails."""
    stats = [spark.read.parquet(_path(p, "amounts")) for p in parts]
    filled = [(p, s.select("n", "start").first()) for p, s in zip(parts, stats)]  # a row per part
    filled = [(p, r) for p, r in filled if r["n"]]
    if not filled:
        return None
    total, start = sum(r["n"] for _, r in filled), max(r["start"] for _, r in filled)
    tails = sketches = None
    for part, _ in filled:
        tail, sketch = spark.read.parquet(_path(part, "tail")), spark.read.parquet(_path(part, "amounts")).select("sketch")
        tails = tail if tails is None else tails.unionByName(tail)
        sketches = sketch if sketches is None else sketches.unionByName(sketch)
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    guess = merged.select(F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, quantile - margin)))).alias("x")).first()["x"]
    for low in (max(start, guess), start):
        near = tails.where(F.col(AMOUNT) >= low).select(AMOUNT)
        count = near.count()
        if count and math.floor(quantile * (total - 1)) >= total - count:
            return quantiles(near, {"limit": (AMOUNT, quantile)}, below=total - count), tails
    return None


def large_counts(amounts: DataFrame, limit: Column) -> DataFrame:
    """(Location, Date, large) from rows of branch, day and amount."""
    return amounts.where(F.col(AMOUNT) > limit).groupBy("Location", "Date").agg(F.count(F.lit(1)).alias("large"))
