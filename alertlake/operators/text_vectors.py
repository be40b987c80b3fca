"""Dense vectors of texts: a truncated singular value decomposition of the term weights, found by random projections.

The matrix has a row per text and a column per word, and stays in the shards of ``text_search.text_index``. A pass multiplies every shard with
a table of one small vector per word; a shard gets the vectors of its own words by a join, as it gets their statistics. What reaches the
driver are square matrices with as many rows as the vectors have places, never anything that grows with the corpus.

1. Random vectors of all words, made from hashes, span the start: Y = A W.
2. Y's Gram matrix, summed over shards, gives R with Q = Y R^-1 orthonormal. Z = A^T Q is the next table of word vectors; repeated.
3. With B = Q^T A, the eigenvectors E of B B^T and the singular values S, the texts' vectors are the first columns of Q E S.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.operators.text_search import INDEX, asked_words, opened
from alertlake.workspace import store

DIMENSIONS, EXTRA, ITERATIONS = 32, 8, 2
#: Products that a task holds at once.
CELLS_AT_ONCE = 2_000_000
SMALL = 1e-10


def random_vectors(words: list[str], width: int, seed: int) -> np.ndarray:
    """Gaussian vectors that depend on the word and the seed alone."""
    name = pd.util.hash_array(np.array(words, dtype=object), hash_key=f"{seed:016d}")[:, None]
    with np.errstate(over="ignore"):
        x = name + np.arange(1, 2 * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    return np.sqrt(-2 * np.log(u[:, :width])) * np.cos(2 * np.pi * u[:, width:])


def sums_by(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray, vectors: np.ndarray, number: int) -> np.ndarray:
    """The sparse matrix (rows, columns, weights) times ``vectors``, some entries at a time."""
    out = np.zeros((number, vectors.shape[1]))
    step = max(1, CELLS_AT_ONCE // vectors.shape[1])
    order = np.argsort(rows, kind="stable")
    for at in range(0, len(order), step):
        part = order[at : at + step]
        own = rows[part]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts]] += np.add.reduceat(weights[part, None] * vectors[columns[part]], starts, axis=0)
    return out


def lists_of(vectors: np.ndarray) -> pa.ListArray:
    """A column with a list for every row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))


def _shard(row: dict, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, words, weights, Y) of a shard."""
    doc, word, weight = opened(row["doc"], row["word"], row["weight"])
    if "y" in row:
        return doc, word, weight, np.frombuffer(row["y"], np.float64).reshape(-1, width)
    vectors = random_vectors(row["words"], width, seed) if row["words"] else np.zeros((0, width))
    return doc, word, weight, sums_by(doc, word, weight, vectors, len(row["ids"]))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one at a time; the vectors stay as Arrow holds them."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in names if c != "v"}
        if "v" in names:
            row["v"] = batch.column("v")[i].values.to_numpy()
        yield row


def _with_products(index: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """The shards, each with ``y``, the product with the vectors of its words. These reach a task for one shard at a time, and aren't kept."""
    answers = asked_words(index).join(table, "word").select("asking", "place", "v")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for i in range(rows.num_rows):
            vectors = np.zeros((len(rows.column("words")[i]), width))
            for part in answers.select(["place", "v"]).to_batches():
                vectors[part.column(0).to_numpy()] = part.column(1).flatten().to_numpy().reshape(-1, width)
            doc, word, weight = opened(*[rows.column(c)[i].as_py() for c in ("doc", "word", "weight")])
            made.append(sums_by(doc, word, weight, vectors, len(rows.column("ids")[i])).tobytes())
        return rows.append_column("y", pa.array(made, pa.binary()))

    return index.groupBy("shard").cogroup(answers.groupBy("asking")).applyInArrow(run, f"{INDEX}, y binary")


def _gram(rows: DataFrame, width: int, make) -> np.ndarray:
    """The sum over tasks of the Gram matrices of what ``make`` gives for a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for row in _rows(batch):
                y = make(row)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], names=["i", "x"])

    out = np.zeros(width * width)
    for r in rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # width^2 numbers
        out[r["i"]] = r["x"]
    return out.reshape(width, width)


def _inverse_root(gram: np.ndarray) -> np.ndarray:
    """M with (Y M)^T (Y M) = 1 for Y's Gram matrix; directions that Y doesn't have become zero."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > SMALL * max(values.max(initial=0.0), 1e-300)
    return vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1.0)), 0.0)


def _word_table(rows: DataFrame, width: int, seed: int, root: np.ndarray) -> DataFrame:
    """(word, v): A^T Q, summed over shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                doc, word, weight, y = _shard(row, width, seed)
                z = sums_by(word, doc, weight, y @ root, len(row["words"]))
                yield pa.RecordBatch.from_arrays([pa.array(row["words"], pa.string()), lists_of(z)], names=["word", "v"])

    parts = rows.mapInArrow(run, "word string, v array<double>")
    sums = parts.groupBy("word").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)])
    return store(sums.select("word", F.array(*[F.col(f"v{i}") for i in range(width)]).alias("v")), "word-vectors", tidy=True)


def text_vectors(index: DataFrame, dimensions: int = DIMENSIONS, iterations: int = ITERATIONS, extra: int = EXTRA, seed: int = 17) -> DataFrame:
    """(id, embedding): for every text of a text index its coordinates along the ``dimensions`` greatest singular directions.

    Texts without words, and directions beyond the matrix's rank, are zero. The dot product of two vectors approaches that of the texts' term
    weights as the dimensions grow. The same index and seed give the same vectors, but for the order of sums.
    """
    width, table = dimensions + extra, None
    index = index.select("shard", "ids", "words", "doc", "word", "weight")
    for _ in range(iterations + 1):
        rows = store(_with_products(index, table, width), "text-vectors", True, True) if table is not None else index
        root = _inverse_root(_gram(rows, width, lambda row: _shard(row, width, seed)[3]))
        table = _word_table(rows, width, seed, root)
    values, vectors = np.linalg.eigh(_gram(table, width, lambda row: row["v"][None, :]))
    order = np.argsort(-values)[:dimensions]
    turned = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(axis=0), order])
    last = root @ turned * np.sqrt(np.maximum(values[order], 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                made = (_shard(row, width, seed)[3] @ last).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.string()), lists_of(made)], names=["id", "embedding"])

    return rows.mapInArrow(run, "id string, embedding array<float>")
