"""Line dedup: lines that stand on many sites are boilerplate; all but their first place in the corpus are removed.

A HyperLogLog sketch of the sites of every line hash is merged by aggregation, so a hot line shuffles one sketch per task.
Sketches settle the lines that are clearly above or below the threshold; the sites of lines near it are counted exactly.
Lines are compared without the blanks at their ends, by 128 bits of hash. Only DataFrame functions are used.

Defined cases: a null text has no lines and stays null; blank lines are never removed or counted; a null site is no site; the
first place is the smallest (id, line number), so one copy of every line stays; equal rows are treated alike; texts that lose
all lines become empty, and no row is dropped; columns other than the text pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import store

BLANKS = " \t\r"


@dataclass(frozen=True)
class Spread:
    min_sites: int = 5
    lg_k: int = 12

    @property
    def band(self) -> float:
        """Estimates this close to the threshold are counted exactly: three standard errors, one at least."""
        return max(1.0, 3 * 1.04 / math.sqrt(2**self.lg_k) * self.min_sites)


def text_key(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit("second"), *columns).alias("r2")]


def line_places(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(r1, r2, id, site, pos, h, g) of every line that isn't blank; r is the row's key, h and g the line's."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(
        *text_key(F.col(id_col), text), F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(BLANKS))
    return (rows.withColumn("line", line).where(F.col("line") != "")
            .select("r1", "r2", "id", "site", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("line"), "line").alias("g")))


def boilerplate_places(docs: DataFrame, spread: Spread = Spread(), id_col: str = "doc_id", text_col: str = "text",
                       site_col: str = "source") -> DataFrame:
    """(r1, r2, pos) of the lines to remove."""
    places = line_places(docs, id_col, text_col, site_col)
    sketched = places.groupBy("h", "g").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(spread.lg_k))).alias("sites"), F.min(F.struct("id", "pos")).alias("first"))
    # Written once: Spark then knows the size of what it joins every line with.
    wide = store(sketched.where(F.col("sites") >= spread.min_sites - spread.band), "lines-wide")
    found = store(places.join(wide, ["h", "g"]).select(
        "h", "g", "site", "r1", "r2", "pos", (F.col("sites") <= spread.min_sites + spread.band).alias("near"),
        (F.struct("id", "pos") == F.col("first")).alias("stays")), "lines-found")
    exact = (found.where("near").groupBy("h", "g").agg(F.count_distinct("site").alias("exact"))
             .where(F.col("exact") >= spread.min_sites).select("h", "g"))
    sure = found.where(~F.col("near")).select("r1", "r2", "pos", "stays")
    near = found.where("near").join(exact, ["h", "g"], "left_semi").select("r1", "r2", "pos", "stays")
    return sure.unionByName(near).where(~F.coalesce("stays", F.lit(False))).select("r1", "r2", "pos")


def dedup_lines(docs: DataFrame, spread: Spread = Spread(), id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """The documents with boilerplate lines cut out of the text, and two counts. A column named like a count gives way to it."""
    removed = store(boilerplate_places(docs, spread, id_col, text_col, site_col).groupBy("r1", "r2")
                    .agg(F.collect_set("pos").alias("cut")), "lines-removed")
    text = F.col(text_col).cast("string")
    keys = text_key(F.col(id_col), text)
    rows = docs.select(F.struct("*").alias("row"), text.alias("body"), *keys).join(removed, ["r1", "r2"], "left")
    lines = F.split("body", "\n")
    last = F.size(lines) - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), F.col("cut")), lambda i: F.get(lines, i))
    counted = rows.select("row", "body", "cut", F.when(F.col("body").isNull(), 0).otherwise(F.size(lines)).alias("all"),
                          F.when(F.col("cut").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("new"))
    others = [F.col("new").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
              if c.lower() not in (n_lines.lower(), n_removed.lower())]
    return counted.select(*others, F.col("all").cast("long").alias(n_lines),
                          F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias(n_removed))
