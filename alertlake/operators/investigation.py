"""Investigations of single transactions that read the asked customers' rows only.

A snapshot is sorted by customer and time over range partitions, so that the least and greatest values which Parquet keeps of every file,
row group and page tell what needn't be read; a Bloom filter of the ids does so for the search of the asked rows themselves. Each rule
is then given the rows it can look at: the asked rows alone, those of their customers in the time it looks back, or all of their customers'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators import alerts as A
from alertlake.operators import detectors as D
from alertlake.operators.quantiles import quantiles
from alertlake.operators.sizing import input_bytes

ROWS, LIMIT = "rows", "limit"
FILE_BYTES = 128 << 20
#: Asked ids of one call. They are literals of every scan's filter; for more, ``alerts.investigate`` joins tables.
MOST_IDS = 1000
#: Customers whose time ranges are told one by one; more share the range of them all.
MOST_RANGES = 50


@dataclass(frozen=True)
class Look:
    """A rule and how far it looks back, in microseconds: 0 for the row alone, None for the customer's whole history."""

    find: Callable[[DataFrame], DataFrame]
    reach: int | None


def write_snapshot(df: DataFrame, path: str, quantile: float = 0.95) -> str:
    """Write transactions sorted by customer and time, and the limit of large amounts, which no rule then has to look for.

    A customer with very many rows spans several files, as the ranges are cut by time too. Rows without a customer are kept, first.
    """
    files = max(1, (input_bytes(df) or 0) // FILE_BYTES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(files, "CustomerID", "TransactionDate").sortWithinPartitions("CustomerID", "TransactionDate")
    writer = ordered.write.option("parquet.block.size", 16 << 20).option("parquet.bloom.filter.enabled#TransactionID", True)
    writer.parquet(f"{path}/{ROWS}")
    rows = df.sparkSession.read.parquet(f"{path}/{ROWS}")
    quantiles(rows.select("TransactionAmount"), {"limit": ("TransactionAmount", quantile)}).select(F.col("limit").alias("TransactionAmount")) \
        .write.parquet(f"{path}/{LIMIT}")
    return path


def _ranges(asked: list, reach: int, kind: str) -> Column:
    """Rows of the asked customers from ``reach`` before their first asked row to their last. Times come as text and sort as such."""
    spans: dict = {}
    for row in asked:
        if row["CustomerID"] is not None and row["TransactionDate"] is not None:
            low, high = spans.get(row["CustomerID"], (row["TransactionDate"], row["TransactionDate"]))
            spans[row["CustomerID"]] = min(low, row["TransactionDate"]), max(high, row["TransactionDate"])
    if not spans:
        return F.lit(False)

    def between(low, high) -> Column:
        start = F.lit(low).cast(kind) - F.make_dt_interval(secs=F.lit(reach / 1e6).cast("decimal(18,6)"))
        return (F.col("TransactionDate") >= start) & (F.col("TransactionDate") <= F.lit(high).cast(kind))

    if len(spans) > MOST_RANGES:
        return F.col("CustomerID").isin(*spans) & between(min(s[0] for s in spans.values()), max(s[1] for s in spans.values()))
    return reduce(lambda a, b: a | b, [(F.col("CustomerID") == c) & between(*span) for c, span in sorted(spans.items())])


def investigate_ids(spark: SparkSession, path: str, ids: list[str], looks: dict[str, Look], limits: D.Limits = D.UPLOAD) -> DataFrame:
    """The asked transactions of a snapshot with every rule they break: the row rules, rapid succession, and those of ``looks``.

    Unknown and repeated ids give nothing more; an id that several rows carry gives all of them, with the rules that any of them breaks. A
    row without a customer or time breaks row rules only. What comes to the driver is the customer and time of the asked rows.
    """
    ids = sorted({str(i) for i in ids})
    if len(ids) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids; join tables with alerts.investigate for more")
    rows = spark.read.parquet(f"{path}/{ROWS}")
    own = rows.where(F.col("TransactionID").isin(*ids)) if ids else rows.limit(0)
    asked = own.select("CustomerID", F.col("TransactionDate").cast("string").alias("TransactionDate")).collect()
    customers = sorted({r["CustomerID"] for r in asked if r["CustomerID"] is not None})
    if customers:  # so that the asked rows, too, are sought in their customers' files only
        nobody = any(r["CustomerID"] is None for r in asked)
        own = own.where(F.col("CustomerID").isin(*customers) | F.col("CustomerID").isNull() if nobody else F.col("CustomerID").isin(*customers))
    history = rows.where(F.col("CustomerID").isin(*customers) if customers else F.lit(False))

    def seen(reach: int | None) -> DataFrame:
        return history if reach is None else own if reach == 0 else rows.where(_ranges(asked, reach, dict(rows.dtypes)["TransactionDate"]))

    judged = D.row_rules(own, limits, amounts=spark.read.parquet(f"{path}/{LIMIT}"))
    rapid = D.rapid_rows(seen(int(limits.velocity_minutes * D.MINUTE)), limits.velocity_minutes)
    tags = [D.tagged_rows(own, judged).select("TransactionID", "anomaly_type"),
            rapid.select("TransactionID", F.lit("velocity_anomaly").alias("anomaly_type"))]
    for name, look in looks.items():
        tags.append(A.pattern_tags(own, {name: look.find(seen(look.reach))}))
    return A.investigate(own, tags, own)
