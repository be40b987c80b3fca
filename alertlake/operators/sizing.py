"""Plan-time size checks. They read optimizer statistics only and start no job."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

def input_bytes(df: DataFrame) -> int | None:
    """Total size of the relations a plan reads, or None when Spark cannot tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    except Exception:
        return None


def spread_small(df: DataFrame, smallest: int = 1 << 20, largest: int = 1 << 28, piece: int = 1 << 20) -> DataFrame:
    """Use all cores for a small table that a few row groups would otherwise give to one or two tasks.

    For work that costs much more per row than moving the row. Tables beyond ``largest`` have many splits of their own and are
    left alone, as are those of unknown size.
    """
    size = input_bytes(df)
    if size is None or not smallest <= size <= largest:
        return df
    return df.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / piece))))
