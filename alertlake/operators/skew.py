"""Per-key ordering without putting a key's whole history into one task.

A customer or branch may own a third of all rows. Windows here are therefore partitioned by (key, time slice). Rows that a
neighbouring slice must see are handed over explicitly, so results equal those of one window over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.schema import quoted

MINUTE = 60 * 1_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

SLICE = "_slice"
NATIVE = "_native"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zoned or zoneless timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST(`{ts}` AS TIMESTAMP_NTZ))")


def sliced_with_reach(df: DataFrame, ts: str, reach: int, width: int | None = None) -> DataFrame:
    """Give each row its time slice, and hand a copy to the next slice when it lies within ``reach`` of that slice.

    For conditions that look back at most ``reach`` microseconds. With the default width about one row in twelve is copied.
    Copies carry ``_native = false``; drop them after the window.
    """
    width = max(width or 12 * reach, reach, 1)
    own = F.floor(micros(ts) / F.lit(width))
    last = F.floor((micros(ts) + F.lit(reach)) / F.lit(width))
    return (
        df.where(quoted(ts).isNotNull())
        .withColumn("_own", own)
        .withColumn(SLICE, F.explode(F.sequence(F.col("_own"), last)))
        .withColumn(NATIVE, F.col(SLICE) == F.col("_own")).drop("_own")
    )


def slice_window(key: str) -> Window:
    return Window.partitionBy(quoted(key), F.col(SLICE))


def with_previous(df: DataFrame, key: str, ts: str, tie: str, take: dict[str, str], width: int = 30 * DAY,
                  keep_unkeyed: bool = True) -> DataFrame:
    """Add the key's previous row's values, however far back it lies: ``take`` = {new column: source column}.

    Only the last row of each (key, slice) travels to the key's next slice that has rows. Rows without key or time have no
    previous row; they are kept unless ``keep_unkeyed`` is off.
    """
    base = df.withColumn(SLICE, F.floor(micros(ts) / F.lit(width)))
    usable = quoted(key).isNotNull() & quoted(ts).isNotNull()
    keyed = base.where(usable)
    fields = list(dict.fromkeys([ts, key, *take.values()]))
    by_slice = keyed.groupBy(quoted(key).alias("_key"), SLICE)
    if set(fields) == {ts, key}:
        # Only the time is wanted: its maximum needs no whole rows, so it aggregates by hash.
        last = by_slice.agg(F.max(quoted(ts)).alias(ts)).withColumnRenamed("_key", key)
    else:
        row = F.struct(*[quoted(c) for c in dict.fromkeys([ts, tie, *fields])])
        last = by_slice.agg(F.max(row).alias("_last")).select(
            "_key", SLICE, *[F.col("_last").getField(f).alias(f) for f in fields])
        last = last.drop(key).withColumnRenamed("_key", key)
    following = F.lead(SLICE).over(Window.partitionBy(quoted(key)).orderBy(SLICE))
    carried = last.withColumn(SLICE, following).where(F.col(SLICE).isNotNull()).withColumn(NATIVE, F.lit(False))
    rows = keyed.withColumn(NATIVE, F.lit(True)).unionByName(carried, allowMissingColumns=True)
    order = slice_window(key).orderBy(F.col(NATIVE), quoted(ts), quoted(tie))
    result = (
        rows.select("*", *[F.lag(quoted(source)).over(order).alias(name) for name, source in take.items()])
        .where(F.col(NATIVE)).drop(NATIVE, SLICE)
    )
    if not keep_unkeyed:
        return result
    skipped = base.where(~usable).drop(SLICE).select(
        "*", *[F.lit(None).cast(df.schema[source].dataType).alias(name) for name, source in take.items()])
    return result.unionByName(skipped)


def number_rows(df: DataFrame, order: str, name: str, ranges: int = 1000) -> DataFrame:
    """Consecutive numbers 1..n along a unique numeric column.

    Rows are cut at approximate quantiles of ``order``; the number is the row's place in its range plus the sizes of the lower
    ranges. Where the cuts fall changes only the balance, never the numbers.
    """
    cuts = sorted(set(df.select(order).approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    ranged = df.withColumn("_range", _cuts_below(quoted(order).cast("double"), bounds))
    # At most ``ranges`` counts come to the driver.
    sizes = {r["_range"]: r["_n"] for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).collect()}
    before = [0]
    for i in range(len(cuts)):
        before.append(before[-1] + sizes.get(i, 0))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(quoted(order)))
    offset = F.array(*[F.lit(b).cast("bigint") for b in before])[F.col("_range")]
    return ranged.withColumn("_place", place).withColumn(name, offset + F.col("_place")).drop("_range", "_place")


def _cuts_below(value: Column, bounds: Column) -> Column:
    return F.size(F.filter(bounds, lambda cut: cut < value))
