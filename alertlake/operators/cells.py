"""An inverted file of vectors: documents by cell, and searches that read the cells that can hold a hit.

Cells are the nearest of some centroids, which are fitted on a bounded sample; every document is written to its cell's folder. A cell
knows its radius, so no document of it is nearer to a question than the centroid's distance less the radius. A question reads its
nearest cells first, then, a round at a time, those whose bound is not worse than its k-th hit. With the whole radius the result is exact;
``reach`` below 1 counts a part of it, reads less and may miss hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.operators.retrieval import CELLS_AT_ONCE, DISTANCE_DIGITS, HIT_SCHEMA, QUESTIONS_AT_ONCE, _ranked
from alertlake.workspace import store

#: Documents of the sample that fits the centroids, and cells at most: both bound what the driver and every task hold.
SAMPLE, CELLS = 20_000, 4096
ITERATIONS = 8
FIRST_PROBES = 4
#: Rows of a cell that one task writes, about.
ROWS_A_TASK = 1 << 20
#: Distances within this of a bound count as equal to it, as both are rounded.
SLACK = 1e-4
INDEX_SCHEMA = "cell int, id string, vector array<float>, apart double"


@dataclass(frozen=True)
class Cells:
    """Where the documents are, and of each cell its centroid, its radius and its number of documents."""

    path: str
    centroids: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    metric: str


def unit(vectors: np.ndarray, metric: str) -> np.ndarray:
    """For the cosine, vectors of length 1 (null vectors stay): squared distances are then twice the cosine distance."""
    if metric != "cosine":
        return vectors
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-300)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares, products = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :], a @ b.T
    products *= 2.0
    squares -= products
    return np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray, at_once: int = CELLS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of the centroid nearest to every vector, some distances at a time."""
    near, apart = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    step = max(1, at_once // max(1, len(centroids)))
    for at in range(0, len(vectors), step):
        part = distances(vectors[at : at + step], centroids)
        near[at : at + step] = own = np.argmin(part, axis=1)
        apart[at : at + step] = part[np.arange(len(own)), own]
    return near, apart


def fit_centroids(documents: DataFrame, cells: int, metric: str = "cosine", sample: int = SAMPLE) -> np.ndarray:
    """Lloyd's algorithm over the ``sample`` vectors with the least hashes. Fewer distinct vectors than cells give fewer centroids."""
    order = F.xxhash64("embedding", F.col("id").cast("string"))
    rows = documents.where(F.col("embedding").isNotNull()).select("embedding", order.alias("order")).orderBy("order").limit(sample)
    vectors = unit(np.array([list(r["embedding"]) for r in rows.collect()], np.float64), metric)
    if not len(vectors):
        return np.zeros((0, 0))
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.random.default_rng(5).permutation(len(distinct))[:cells]]
    for _ in range(ITERATIONS):
        near, _ = nearest_centroids(vectors, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return centroids


def cells_for(rows: int) -> int:
    """About the square root of the number of documents, as is usual, up to a bound."""
    return max(1, min(CELLS, int(math.sqrt(rows))))


def build_cells(documents: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Write (id, embedding) of every document with a vector to the folder of its cell. Hot cells are written by several tasks."""
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    spark, known = documents.sparkSession, documents.where(F.col("embedding").isNotNull())
    total = known.count()
    centroids = fit_centroids(known, cells or cells_for(total), metric, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                vectors = unit(flat.reshape(batch.num_rows, -1).astype(np.float64), metric)
                cell, apart = nearest_centroids(vectors, centroids)
                ends = pa.array(np.arange(batch.num_rows + 1) * vectors.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(apart)],
                                                 names=["cell", "id", "vector", "apart"])

    size = F.when(F.size("embedding") == centroids.shape[1], F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"a vector hasn't {centroids.shape[1]} dimensions")).cast("array<float>"))
    placed = known.select(F.col("id").cast("string").alias("id"), size.cast("array<float>").alias("embedding")).mapInArrow(assign, INDEX_SCHEMA)
    # A cell's rows go to as many tasks as the table would fill, so a hot cell is never one task's.
    tasks = max(1, math.ceil(total / ROWS_A_TASK))
    salt = F.pmod(F.xxhash64("id"), F.lit(tasks))
    placed.repartition("cell", salt).write.partitionBy("cell").parquet(path)
    found = spark.read.schema(INDEX_SCHEMA).parquet(path).groupBy("cell").agg(F.max("apart").alias("radius"), F.count(F.lit(1)).alias("rows"))
    radius, rows = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in found.collect():  # one row per cell
        radius[r["cell"]], rows[r["cell"]] = r["radius"], r["rows"]
    return Cells(path, centroids, radius, rows, metric)


@dataclass(frozen=True)
class Found:
    """Hits (query_id, id, rank, distance), and how many documents were read for each question."""

    hits: DataFrame
    rows_read: dict[str, int]


def search_cells(spark: SparkSession, index: Cells, queries: DataFrame, k: int = 5, reach: float = 1.0,
                 first: int = FIRST_PROBES, at_once: int = QUESTIONS_AT_ONCE) -> Found:
    """The k nearest documents of every question (query_id, embedding), equal distances by id.

    Questions come to the driver in blocks of about ``at_once``. Each round scans the folders of the cells that some question still wants, and
    no others; a document is compared with the questions that want its cell. Rounds double the cells per question, so there are few.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    total = asked.count()
    hits, read = spark.createDataFrame([], HIT_SCHEMA), {}
    blocks = math.ceil(total / at_once) if len(index.centroids) else 0
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if rows:
            part = _search_block(spark, index, [r["query_id"] for r in rows], np.array([list(r["embedding"]) for r in rows], np.float64), k, reach, first, read)
            hits = hits.unionByName(part)
    return Found(_ranked(hits, k).drop("collection"), read)


def _search_block(spark, index: Cells, ids: list[str], vectors: np.ndarray, k: int, reach: float, first: int, read: dict[str, int]) -> DataFrame:
    apart = distances(unit(vectors, index.metric), index.centroids)
    bounds = np.maximum(apart - reach * index.radius[None, :], 0.0)
    bounds[:, index.rows == 0] = np.inf
    open_, limits = np.isfinite(bounds), np.full(len(ids), np.inf)
    hits, step = spark.createDataFrame([], HIT_SCHEMA), first
    while open_.any():
        wanted: dict[int, list[int]] = {}
        for q in np.flatnonzero(open_.any(axis=1)):
            cells = np.flatnonzero(open_[q])
            for c in cells[np.argsort(apart[q, cells], kind="stable")[:step]]:
                wanted.setdefault(int(c), []).append(int(q))
                open_[q, c] = False
                read[ids[q]] = read.get(ids[q], 0) + int(index.rows[c])
        part = store(_ranked(_probe(spark, index, wanted, ids, vectors, k), k).select("query_id", "collection", "id", "distance"), "cell-hits")
        hits = hits.unionByName(part)
        place = {id_: q for q, id_ in enumerate(ids)}
        for r in _ranked(hits, k).where(F.col("rank") == k).select("query_id", "distance").collect():  # one number per question
            limits[place[r["query_id"]]] = math.sqrt(2 * max(r["distance"], 0)) if index.metric == "cosine" else r["distance"]
        open_ &= bounds <= limits[:, None] + SLACK
        step *= 2
    return hits


def _probe(spark, index: Cells, wanted: dict[int, list[int]], ids: list[str], vectors: np.ndarray, k: int) -> DataFrame:
    """Each task's k best documents for every question that wants a cell of the task."""
    metric = index.metric
    shared = spark.sparkContext.broadcast(({c: np.array(q, np.int32) for c, q in wanted.items()}, ids, vectors))
    in_cells: Column = F.col("cell").isin(sorted(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, ids, vectors = shared.value
        best: dict[int, list[tuple[float, str]]] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy()
            known = batch.column(1).to_pylist()
            own = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            for cell in np.unique(cells):
                rows, all_asked = np.flatnonzero(cells == cell), wanted[int(cell)]
                step = max(1, CELLS_AT_ONCE // len(rows))
                for at in range(0, len(all_asked), step):  # some distances at a time
                    asked = all_asked[at : at + step]
                    found = _metric(own[rows], vectors[asked], metric)
                    for j, q in enumerate(asked.tolist()):
                        held = best.get(q, [])
                        limit = held[-1][0] if len(held) == k else np.inf
                        near = np.flatnonzero(found[:, j] <= limit)
                        if len(near) > k:
                            near = near[found[near, j] <= np.partition(found[near, j], k - 1)[k - 1]]
                        best[q] = sorted(held + [(float(found[i, j]), known[rows[i]]) for i in near])[:k]
        out = [(ids[q], "", i, d) for q, held in best.items() for d, i in held]
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:3]], pa.array(columns[3], pa.float64())],
                                         names=["query_id", "collection", "id", "distance"])

    rows = spark.read.schema(INDEX_SCHEMA).parquet(index.path).where(in_cells).select("cell", "id", "vector")
    return rows.mapInArrow(run, HIT_SCHEMA)


def _metric(documents: np.ndarray, questions: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.sqrt((documents * documents).sum(axis=1))[:, None] * np.sqrt((questions * questions).sum(axis=1))[None, :]
        similarity = documents @ questions.T
        return np.round(1.0 - np.divide(similarity, norms, out=np.zeros_like(similarity), where=norms > 0), DISTANCE_DIGITS) + 0.0
    return np.round(distances(documents, questions), DISTANCE_DIGITS)
