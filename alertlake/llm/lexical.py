"""Exact ranked search of documents for stated items: posting lists in blocks of similar documents, with summaries that allow skipping.

The index has one row per shard, a few thousand consecutive documents of a task. For each term that some item holds, a shard keeps its posting
list in blocks: documents are grouped by the nearest of some of the list's own documents (cosine of sketches of their impacts), and
a block's summary is the coordinatewise maximum of its documents' impacts, over all terms that stand in an item together with the list's
own. An item's score of any document of a block is at most the item's weights times the summary; blocks whose bound is below the item's tenth best score so far are skipped, and the documents
of all others are scored exactly, in 64-bit integers. A document with a score stands in a list of some term of the item, and is only left out
if its block's bound shows that it can't be among the best.

Each task carries the best scores from shard to shard, and starts from those of a bounded number of shards that are searched first.
What leaves a task is at most ``top`` rows per item.
"""

from __future__ import annotations

import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.llm.common import id_and_text, slices, store, with_id
from alertlake.llm.runs import planes, unplanes

#: Documents and bytes of text of a shard at most (a longer text is a shard of its own).
SHARD_DOCS, SHARD_BYTES = 2048, 16 << 20
#: Documents times terms of a shard at most.
CELLS = 1 << 23
#: Documents of a block on average, and coordinates of the sketches by which they are grouped.
BLOCK, SKETCH = 24, 64
#: Bytes of item texts, and items, of one search over the index.
ITEM_BYTES, ITEMS = 1 << 20, 1024
#: Shards that are searched first for starting scores: the first one of as many tasks.
FIRST = 8

KEPT = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in KEPT else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and all other characters beyond ASCII; only A to Z lowered."""
    return text.translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, their terms, and the weight of each term of the items (in the order of ``terms``)."""

    documents: int
    length: int
    terms: list[bytes]
    weights: np.ndarray


def statistics(docs: DataFrame, terms: list[bytes], text_col: str = "text") -> Statistics:
    """Counts over all documents: one row per task, with as many numbers as the items have terms."""
    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {t: i for i, t in enumerate(terms)}
        found, documents, length = np.zeros(len(terms), np.int64), 0, 0
        for _, texts in slices(batches):
            for text in texts:
                words = terms_of(text)
                documents, length = documents + bool(words), length + len(words)
                found[[place[w] for w in place.keys() & set(words)]] += 1
        yield pa.record_batch([pa.array([documents], pa.int64()), pa.array([length], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))],
                              ["documents", "length", "found"])

    parts = id_and_text(docs, text_col, text_col).mapInArrow(count, "documents long, length long, found array<long>")
    sums = parts.agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")).first()
    n, length = sums["documents"] or 0, sums["length"] or 0
    df = np.zeros(len(terms), np.int64)
    for row in parts.select(F.posexplode("found").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("df")).collect():
        df[row["at"]] = row["df"]
    return Statistics(n, length, terms, np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64))


def impacts(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    """What a term adds to a score per unit of its weight, from its occurrences and the document's number of terms."""
    m = 100 - 75 + (75 * n * stats.documents) // max(stats.length, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def blocks_of(members: np.ndarray, sketches: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(a posting list's documents block by block, where blocks start). A block's documents are nearest to one of some of the list's own."""
    if len(members) <= size:
        return members, np.zeros(1, np.int64)
    near = np.argmax(sketches[members] @ sketches[members[::size]].T, axis=1)
    order = np.argsort(near, kind="stable")
    return members[order], np.flatnonzero(np.diff(near[order], prepend=-1))


def neighbours(own: np.ndarray, items: list[np.ndarray], terms: int) -> Iterator[np.ndarray]:
    """For each of a shard's terms, the places (among these) of those that stand in an item with it, itself included."""
    column = np.full(terms, -1, np.int64)
    column[own] = np.arange(len(own))
    here = [column[i] for i in items]
    here = [np.sort(c[c >= 0]) for c in here]
    holds = [[] for _ in own]
    for i, columns in enumerate(here):
        for c in columns.tolist():
            holds[c].append(i)
    for c in range(len(own)):
        yield here[holds[c][0]] if len(holds[c]) == 1 else np.unique(np.concatenate([here[i] for i in holds[c]]))


def shard_index(found: list[Counter], lengths: list[int], stats: Statistics, place: dict[bytes, int], items: list[np.ndarray],
                size: int = BLOCK) -> dict[str, np.ndarray]:
    """The index of a shard: documents' impacts by term, blocks by term, and the blocks' summaries, all as flat arrays."""
    doc, term, tf = (np.array(x, np.int64) for x in zip(*((d, place[w], c) for d, own in enumerate(found) for w, c in own.items())))
    value = impacts(tf, np.array(lengths, np.int64)[doc], stats)
    own, column = np.unique(term, return_inverse=True)
    exact = np.zeros((len(found), len(own)), np.int32)
    exact[doc, column] = value
    sketches = exact.astype(np.float32) @ np.random.default_rng(7).standard_normal((len(stats.terms), SKETCH), np.float32)[own]
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-30)
    by_term = np.argsort(column, kind="stable")
    lists = np.split(doc[by_term], np.flatnonzero(np.diff(column[by_term])) + 1)
    members, starts, counts, tops = [], [], [], []
    for own_list, near in zip(lists, neighbours(own, items, len(stats.terms))):
        ordered, start = blocks_of(own_list, sketches, size)
        members.append(ordered)
        starts.append(start)
        counts.append(len(start))
        tops.append(np.maximum.reduceat(exact[np.ix_(ordered, near)], start, axis=0).ravel())
    join = lambda parts: np.concatenate(parts).astype(np.int32)
    return {"terms": own, "doc": doc.astype(np.int32), "column": column.astype(np.int32), "value": value.astype(np.int32), "members": join(members),
            "lengths": np.array([len(m) for m in members], np.int32), "starts": join(starts), "counts": np.array(counts, np.int32), "tops": join(tops)}


def build_index(docs: DataFrame, stats: Statistics, items: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS,
                shard_bytes: int = SHARD_BYTES, size: int = BLOCK) -> DataFrame:
    """(shard, ids, body): the written index of every document that holds a term of the items; ids keep the table's own type."""
    shard_docs = max(1, min(shard_docs, CELLS // max(1, len(stats.terms))))

    def index(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        place = {t: i for i, t in enumerate(stats.terms)}
        number, ids, found, lengths, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            body = pickle.dumps({k: (v.dtype.str, planes(v)) for k, v in shard_index(found, lengths, stats, place, items, size).items()})
            return pa.record_batch([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids)
                                    if len(ids) else None), pa.array([body], pa.binary())], ["shard", "ids", "body"])

        for part, texts in slices(batches):
            owners = part.column(0)
            for i, text in enumerate(texts):
                words = terms_of(text)
                own = Counter(filter(place.__contains__, words))
                if own:
                    ids.append(owners.slice(i, 1))
                    found.append(own)
                    lengths.append(len(words))
                    held += len(text)
                    if len(found) >= shard_docs or held >= shard_bytes:
                        yield row()
                        number, ids, found, lengths, held = number + 1, [], [], [], 0
        if found:
            yield row()

    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("body", T.BinaryType())])
    return store(id_and_text(docs, id_col, text_col).mapInArrow(index, schema), "lexical-index")


class Shard:
    """A shard of the index, opened."""

    def __init__(self, ids: list, body: bytes, terms: int, items: list[np.ndarray]):
        self.ids, x = ids, {k: unplanes(v, kind) for k, (kind, v) in pickle.loads(body).items()}
        self.exact = np.zeros((len(ids), len(x["terms"])), np.int32)
        self.exact[x["doc"], x["column"]] = x["value"]
        self.own = np.full(terms, -1, np.int64)
        self.own[x["terms"]] = np.arange(len(x["terms"]))
        self.near = list(neighbours(x["terms"], items, terms))
        cut = lambda values, lengths: np.split(values, np.cumsum(lengths)[:-1])
        self.members, self.starts = cut(x["members"], x["lengths"]), cut(x["starts"], x["counts"])
        sizes = [int(c) * len(n) for c, n in zip(x["counts"], self.near)]
        self.tops = [t.reshape(-1, len(n)) for t, n in zip(cut(x["tops"], sizes), self.near)]

    def block(self, column: int, i: int) -> np.ndarray:
        starts = self.starts[column]
        return self.members[column][starts[i] : starts[i + 1] if i + 1 < len(starts) else None]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, top: int, least: int) -> tuple[int, int]:
        """Put documents that belong to the ``top`` best into a heap of (score, id in the order of ``Last``). Returns (blocks, skipped)."""
        columns = self.own[terms]
        use = (columns >= 0) & (weights > 0)
        columns, weights = columns[use], weights[use]
        if not len(columns):
            return 0, 0
        bounds = [self.tops[c][:, np.searchsorted(self.near[c], columns)] @ weights for c in columns]
        list_, index = np.repeat(columns, [len(b) for b in bounds]), np.concatenate([np.arange(len(b)) for b in bounds])
        bounds = np.concatenate(bounds)
        order = np.argsort(-bounds, kind="stable")
        list_, index, bounds = list_[order], index[order], -bounds[order]
        seen = np.zeros(len(self.ids), bool)
        at, step = 0, 4
        while at < len(bounds):
            floor = max(least, best[0][0] if len(best) >= top else 1)
            stop = min(at + step, int(np.searchsorted(bounds, -floor, side="right")))
            if stop <= at:
                return len(bounds), len(bounds) - at
            members = np.unique(np.concatenate([self.block(c, i) for c, i in zip(list_[at:stop], index[at:stop])]))
            members = members[~seen[members]]
            seen[members] = True
            scores = self.exact[np.ix_(members, columns)] @ weights
            for d in np.flatnonzero(scores >= floor):
                entry = (int(scores[d]), Last(self.ids[members[d]]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            at, step = stop, step * 2
        return len(bounds), 0


class Last:
    """An id in the order in which it gives way to others of its score: greater ids first, and a null before all."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other) -> bool:
        return other.id is not None and (self.id is None or self.id > other.id)

    def __eq__(self, other) -> bool:
        return self.id == other.id


def search_index(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], terms: int, least: np.ndarray, id_type: T.DataType, top: int) -> DataFrame:
    """(item, id, score): each task's best documents of every item; ``items`` are (terms, weights times repeats), ``least`` a score that the
    ``top``-th best is known to reach."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        best: list[list] = [[] for _ in items]
        for batch in batches:
            for ids, body in zip(batch.column(0), batch.column(1)):
                shard = Shard(ids.as_py(), body.as_py(), terms, [own for own, _ in items])
                for heap, (own, weights), floor in zip(best, items, least):
                    shard.search(own, weights, heap, top, int(floor))
        rows = [(i, e[1].id, e[0]) for i, heap in enumerate(best) for e in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to_arrow_schema(schema))] if rows else
                                         [pa.array([], f.type) for f in to_arrow_schema(schema)], schema=to_arrow_schema(schema))

    return index.select("ids", "body").mapInArrow(run, schema)


def ranked(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_items: int = ITEMS, block_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The items, some at a time: bounded by number and bytes (a longer text is a block of its own)."""
    held, size = [], 0
    rows = items.select(F.col(id_col).alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"))
    for row in rows.toLocalIterator():
        text = bytes(row["text"] or b"")
        if held and (len(held) >= block_items or size + len(text) > block_bytes):
            yield held
            held, size = [], 0
        held.append((row["id"], text))
        size += len(text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", first: int = FIRST, **sizes) -> DataFrame:
    """(item id, rank, document id, score): the ``top`` best documents of every item, exactly.

    Scores are integers: the weight of a term is floor(1000 ln((2N + 2) / (2df + 1))), a document's share of it
    10^9 tf div (1000 tf + 8 m) with m = 25 + 75 n N div L, and repeats of a term in the item count. Equal scores go by the document's id,
    null last. Documents and items without a term (null and empty ones too) have no score and no row. Each row of either table
    stands for itself, also if it repeats another or its id; extra columns are not read. Items are taken in blocks of bounded size; each
    block is one build and one search of an index of its terms.
    """
    spark, out = docs.sparkSession, None
    id_type, schema = docs.schema[id_col].dataType, with_id(items, item_id, "rank int")
    schema = T.StructType([*schema.fields, T.StructField(id_col, id_type), T.StructField("score", T.LongType())])
    for block in item_blocks(items, item_id, item_text):
        counted = [Counter(terms_of(text)) for _, text in block]
        stats = statistics(docs, sorted(set().union(*counted)), text_col)
        place = {t: i for i, t in enumerate(stats.terms)}
        asked = [(np.array([place[t] for t in c], np.int64), np.array([stats.weights[place[t]] * n for t, n in c.items()], np.int64)) for c in counted]
        index = build_index(docs, stats, [own for own, _ in asked], id_col, text_col, **sizes)
        least = np.zeros(len(block), np.int64)
        # Any documents' scores are below the best ones', so the top-th best of a few shards is a floor for all.
        few = search_index(index.where(F.col("shard").isin([task << 32 for task in range(first)])), asked, len(stats.terms), least, id_type, top)
        for row in ranked(few, top).where(F.col("rank") == top).collect():
            least[row["item"]] = row["score"]
        hits = ranked(search_index(index, asked, len(stats.terms), least, id_type, top), top)
        names = spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()),
                                      T.StructField("name", items.schema[item_id].dataType)]))
        own = hits.join(F.broadcast(names), "item").select(F.col("name").alias(item_id), "rank", F.col("id").alias(id_col), "score")
        own = spark.createDataFrame([], schema).unionAll(own) if out is None else own
        out = own if out is None else out.unionAll(own)
    return spark.createDataFrame([], schema) if out is None else out
