"""Small helpers that the text operators share.

Every operator reads two columns of its table, an id and a text, so other columns of a table never clash with its own names.
A null text is treated as empty unless an operator says otherwise. Texts are handled as UTF-8 bytes, a few hundred rows at a
time, so that a worker's memory follows the longest texts and not the size of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.workspace import new_folder, store

ROWS_AT_ONCE = 256

__all__ = ["bucketed", "id_and_text", "per_gigabyte", "read_table", "slices", "store", "unused", "with_id"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """The two columns an operator reads, whatever else the table has, then further columns."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def with_id(docs: DataFrame, id_col: str, rest: str, name: str | None = None) -> T.StructType:
    """A result schema: the table's id under its own type, then the columns of a DDL string."""
    head = T.StructField(name or id_col, docs.schema[id_col].dataType, True)
    return T.StructType([head, *T.StructType.fromDDL(rest).fields])


def slices(batches: Iterator, rows: int = ROWS_AT_ONCE) -> Iterator[tuple[object, list[bytes | None]]]:
    """Of Arrow batches whose second column is the text: (a short batch, its texts as bytes, null as None)."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(1).cast(pa.binary()).to_pylist()


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_gigabyte(total_bytes: int, bytes_each: int, least: int = 1) -> int:
    """How many parts of about ``bytes_each`` hold ``total_bytes``."""
    return max(least, math.ceil(total_bytes / bytes_each))


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Write a table to the shared folder in buckets of a key, so that later joins on the key don't move it again."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    name = "llm_" + path.rsplit("-", 1)[-1]
    df.write.option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)
