"""A uniform shuffle of documents into shards whose counts differ by one at most.

Every file of the table is a part. How many rows of each part go to each shard is one draw of a random table with fixed margins
(the parts' row counts and the shards' sizes): each row of it is multivariate hypergeometric given the rows before. Within a part
a keyed bijection permutes the rows, so that the first ``c[0]`` of them go to shard 0, and so on; within a shard a second one
permutes the arrivals. A row's place follows from its file, its row number in it and the seed alone: nothing has to be kept between
passes, a task that runs again gives the same, and the only exchange is the one that moves the documents.

What the driver holds is the list of files with their row counts; it sends 24 bytes per file and one count per shard and ``GROUP``
files, and tasks draw a group's own table again from its seed. Spark's driver holds more than that for every file it lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import store

#: Files whose shares of the shards are drawn together.
GROUP = 1024
#: Rows of one shard that are meant to be written by one task.
CELL_ROWS = 1 << 16
ROUNDS = 6


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` rows, taken without replacement from ``good`` and ``bad`` ones, are good. No limit on the sizes.

    Probabilities relative to the mode follow from the exact ratios of neighbours, over a window of 14 standard deviations, beyond
    which less than 1e-40 of the probability lies.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5
    reach = int(14 * spread) + 40
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)  # step from k to k + 1
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def random_table(rows: list[int], columns: list[int], seed: list[int]) -> np.ndarray:
    """A table of counts with these sums of rows and columns, as a uniform permutation of all rows would give it."""
    rng = np.random.Generator(np.random.Philox(seed=np.random.SeedSequence(seed)))
    left, out = [int(c) for c in columns], np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        n, rest = int(n), sum(left)
        for j, room in enumerate(left):
            rest -= room
            out[i, j] = taken = hypergeometric(room, rest, n, rng)
            left[j] -= taken
            n -= taken
    return out


def mixed(values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values under keys."""
    with np.errstate(over="ignore"):
        x = values + key * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0 to size - 1 sends each index: a Feistel network, applied again until the result is in range."""
    index, size, key = (np.asarray(x).astype(np.uint64) for x in (index, size, key))
    half = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2 + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m = half[todo], mask[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(ROUNDS):
            left, right = right, left ^ (mixed(right, key[todo] + np.uint64(turn)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Plan:
    """What a task needs to place any row: the parts (in the order of their paths; sorted hashes of these, and the part of each), their
    sizes, and the shares of groups of parts."""

    names: np.ndarray
    order: np.ndarray
    rows: np.ndarray
    groups: np.ndarray
    sizes: np.ndarray
    seed: int

    def tables(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a group's parts: rows to each shard, and how many rows of earlier parts each shard has got."""
        own = random_table(self.rows[group * GROUP : (group + 1) * GROUP].tolist(), self.groups[group].tolist(), [self.seed, 1, group])
        return own, self.groups[:group].sum(axis=0) + np.cumsum(own, axis=0) - own

    def place(self, names: np.ndarray, index: np.ndarray, known: dict) -> tuple[np.ndarray, np.ndarray]:
        """(shard, slot) of rows by the names of their parts and their numbers there."""
        part = self.order[np.searchsorted(self.names, names)]
        key = mixed(part.astype(np.uint64), np.full(len(part), self.seed, np.uint64))
        at = permuted(index, self.rows[part], key)
        shard, arrival = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        for p in np.unique(part):
            if p // GROUP not in known:
                known.clear()
                known[p // GROUP] = self.tables(p // GROUP)
            counts, before = (t[p % GROUP] for t in known[p // GROUP])
            own, ends = part == p, np.cumsum(counts)
            shard[own] = to = np.searchsorted(ends, at[own], side="right")
            arrival[own] = at[own] - (ends - counts)[to] + before[to]
        return shard, permuted(arrival, self.sizes[shard], mixed(shard.astype(np.uint64), np.full(len(shard), self.seed + 1, np.uint64)))


def numbered(docs: DataFrame, in_place: bool) -> tuple[DataFrame, Column, Column, Column]:
    """(the table, a row's file, hash of the file, the row's number in it). Unless it stands in files as it is, the table is written first."""
    docs = docs if in_place else store(docs, "shard-input")
    meta = docs.metadataColumn("_metadata")
    return docs, meta["file_path"], F.xxhash64(meta["file_path"]), meta["row_index"]


def plan_of(parts: list[tuple[str, int, int]], shards: int, seed: int) -> Plan:
    """The plan for parts given as (path, its hash, rows)."""
    parts = sorted(parts)
    names, rows = np.array([name for _, name, _ in parts], np.int64), np.array([n for _, _, n in parts], np.int64)
    if len(np.unique(names)) < len(names):
        raise ValueError("two files' paths have one hash; write the table anew")
    total = int(rows.sum())
    sizes = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    of_groups = [int(rows[g : g + GROUP].sum()) for g in range(0, len(rows), GROUP)]
    groups = random_table(of_groups, sizes.tolist(), [seed, 0]) if of_groups else np.zeros((0, shards), np.int64)
    order = np.argsort(names)
    return Plan(names[order], order, rows, groups, sizes, seed)


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 20_231, cell_rows: int = CELL_ROWS, in_place: bool = False) -> DataFrame:
    """Every row of a table with its ``shard`` (from 0) and ``slot`` (gapless from 0 in the shard), in a uniform random order.

    Shards have counts that differ by one at most, the first ones being larger; all shards and slots are equally likely for a row.
    The same table and seed give the same result. Rows come dealt by shard and, in a large shard, by stretches of ``cell_rows`` slots,
    sorted by slot, so a write by shard gives files in shuffled order. Values play no part: nulls, empty or very long texts and repeated
    rows are placed as any row; fewer rows than shards leave shards empty; an empty table gives no rows. A column of the table named
    ``shard`` or ``slot`` gives way to the result's. The table is written once, so that its rows keep their numbers; ``in_place`` says
    that it comes straight from Parquet files, without filter, limit or join, and is numbered there.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    docs, path, name, index = numbered(docs, in_place)
    counted = docs.select(path.alias("path"), name.alias("name"), index.alias("index")).groupBy("path", "name")
    parts = counted.agg(F.count("*").alias("rows"), (F.max("index") + 1).alias("ends")).collect()
    if any(r["rows"] != r["ends"] for r in parts):
        raise ValueError("the table doesn't hold every row of its files once; leave out in_place")
    plan = plan_of([(r["path"], r["name"], r["rows"]) for r in parts], shards, seed)
    sent = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for names, rows in batches:
            shard, slot = sent.value.place(names.to_numpy(), rows.to_numpy(), known)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    placed = F.pandas_udf(place, "shard int, slot long")(name, index)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(*kept, placed.alias("slot")).select(*kept, F.col("slot.shard").alias("shard"), F.col("slot.slot").alias("slot"))
    cells = [-(-int(n) // cell_rows) for n in plan.sizes]
    first = F.array(*[F.lit(sum(cells[:j])) for j in range(shards)])
    return (rows.repartitionById(max(sum(cells), 1), (first[F.col("shard")] + F.expr(f"slot div {cell_rows}")).cast("int"))
            .sortWithinPartitions("shard", "slot"))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 20_231, cell_rows: int = CELL_ROWS, in_place: bool = False) -> DataFrame:
    """Write the shards as folders ``shard=0``, ``shard=1``, ... whose rows are in the order of their slots, and return what was written."""
    shuffle_into_shards(docs, shards, seed, cell_rows, in_place).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
