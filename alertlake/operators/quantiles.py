"""Exact linear-interpolated quantiles.

The built-in ``percentile`` keeps every distinct value in one task. Here values are narrowed by histograms instead, whatever their
number: each pass groups rows into at most 2**16 or so value ranges (combined map-side), finds the range that holds the wanted
rank and looks only inside it in the next pass. The first pass uses logarithmic ranges, so three passes leave at most a few ten
thousand different doubles whatever the distribution, and the last pass counts those exactly. No task ever holds more than the
histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.schema import quoted

RANGES = 1 << 16
RANGES_PER_OCTAVE = 32
NARROWING_PASSES = 2


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], below: int = 0) -> DataFrame:
    """One row with a column per entry of ``wanted`` = {alias: (column, probability)}; NULL and NaN are skipped.

    ``below`` says how many more values there are, all known to be less than those of ``df``; the wanted ranks must lie in ``df``. Runs a job per pass at once. What comes to the driver are two bounds for each of the two ranks of a quantile.
    """
    columns = sorted({column for column, _ in wanted.values()})
    # Two ranks per wanted quantile: the neighbours between which it is interpolated.
    orders = [(alias, side, columns.index(column), float(p)) for alias, (column, p) in wanted.items() for side in (0, 1)]
    targets = _first_pass(df, columns, orders, below)
    for last in (False,) * NARROWING_PASSES + (True,):
        if any(t["low"] < t["high"] for t in targets):
            targets = _pass(df, columns, targets, last)
    found = {(t["alias"], t["side"]): t for t in targets}
    row = [_interpolate(found.get((alias, 0)), found.get((alias, 1))) for alias in wanted]
    return df.sparkSession.createDataFrame([row], ", ".join(f"`{alias}` double" for alias in wanted))


def approximate_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], accuracy: int = 10000) -> DataFrame:
    """Same shape from one pass with a bounded rank error of 1/accuracy. Only used when a caller asks for it."""
    return df.agg(*[
        F.percentile_approx(_number(column), p, accuracy).cast("double").alias(alias)
        for alias, (column, p) in wanted.items()
    ])


def _number(column: str) -> Column:
    return F.nanvl(quoted(column).cast("double"), F.lit(None).cast("double"))


def _log_range(v: Column) -> Column:
    """Range number that never decreases as v grows."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1100.0)) + 1100) * RANGES_PER_OCTAVE) + 1
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def _even_range(v: Column, low: Column, high: Column) -> Column:
    width = high - low
    return F.when(width > 0, F.least(F.floor((v - low) / width * RANGES), F.lit(RANGES - 1))).otherwise(F.lit(0).cast("bigint"))


def _first_pass(df: DataFrame, columns: list[str], orders: list[tuple], below: int = 0) -> list[dict]:
    """The logarithmic range that holds each wanted rank."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _number(c).alias("v")) for i, c in enumerate(columns)])).alias("e"))
    histogram = values.select("e.*").where(F.col("v").isNotNull()).groupBy("t", _log_range(F.col("v")).alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    of_column = Window.partitionBy("t")
    asked = F.array(*[F.struct(F.lit(alias).alias("alias"), F.lit(side).alias("side"), F.lit(c).alias("c"), F.lit(p).alias("p"))
                      for alias, side, c, p in orders])
    position = F.col("o.p") * (F.col("total") + (below - 1)) - below
    ranked = (histogram.withColumn("total", F.sum("n").over(of_column))
              .withColumn("below", F.sum("n").over(of_column.orderBy("r")) - F.col("n"))
              .withColumn("o", F.explode(asked)).where(F.col("o.c") == F.col("t"))
              .withColumn("rank", F.when(F.col("o.side") == 0, F.floor(position)).otherwise(F.ceil(position))))
    rows = _holding(ranked).select("o.alias", "o.side", "t", position.alias("position"), F.col("rank").alias("full_rank"),
                                   (F.col("rank") - F.col("below")).alias("rank"), "low", "high").collect()
    return [r.asDict() for r in rows]


def _pass(df: DataFrame, columns: list[str], targets: list[dict], last: bool) -> list[dict]:
    """Cut every target's range evenly and take the piece that holds its rank; in the last pass every value is a piece.

    The ranges are literals, so rows outside all of them end in the scan.
    """
    ranges = sorted({(t["t"], t["low"], t["high"]) for t in targets if t["low"] < t["high"]})
    inside = F.array_compact(F.array(*[
        F.when(_number(columns[c]).between(low, high), F.struct(F.lit(i).alias("t"), _number(columns[c]).alias("v")))
        for i, (c, low, high) in enumerate(ranges)]))
    values = df.select(F.explode(inside).alias("e")).select("e.*")
    bound = lambda k: F.array(*[F.lit(r[k]) for r in ranges])[F.col("t")]
    piece = F.col("v") if last else _even_range(F.col("v"), bound(1), bound(2))
    counted = values.groupBy("t", piece.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(ranges.index((t["t"], t["low"], t["high"]))).alias("t"), F.lit(t["rank"]).alias("rank"))
                      for k, t in enumerate(targets) if t["low"] < t["high"]])
    ranked = (counted.withColumn("below", F.sum("n").over(Window.partitionBy("t").orderBy("r")) - F.col("n"))
              .withColumn("o", F.explode(asked)).where(F.col("o.t") == F.col("t")).withColumn("rank", F.col("o.rank")))
    found = {r["k"]: r for r in _holding(ranked).select("o.k", (F.col("rank") - F.col("below")).alias("rank"), "low", "high").collect()}
    return [{**t, **{c: found[k][c] for c in ("rank", "low", "high")}} if k in found else t for k, t in enumerate(targets)]


def _holding(ranges: DataFrame) -> DataFrame:
    return ranges.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))


def _interpolate(low: dict | None, high: dict | None) -> float | None:
    if low is None or high is None:
        return None
    if low["full_rank"] == high["full_rank"]:
        return low["low"]
    return (high["full_rank"] - low["position"]) * low["low"] + (low["position"] - low["full_rank"]) * high["low"]
