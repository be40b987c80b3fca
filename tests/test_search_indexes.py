"""The inverted file of vectors and the inverted index of words, against brute force; ingest with stored keys."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.operators import cells as C
from alertlake.operators import retrieval as R
from alertlake.operators import text_search as X
from alertlake.operators import text_vectors as V
from alertlake.plans import jobs
from alertlake.workspace import new_folder


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.RandomState(6)
    centres = rng.randn(12, 8) * 3
    made = (centres[rng.randint(0, 12, 900)] + rng.randn(900, 8)).astype(np.float32)
    made[600:] = made[5]  # a third are copies
    made[17] = 0
    documents = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in made[i]]) for i in range(0, 600, 40)], "query_id long, embedding array<float>")
    return made, documents.cache(), asked.cache()


def hit_lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize(("cells", "first", "at_once"), [(None, 4, 8192), (60, 1, 4)])
def test_cells_are_exact(spark, vectors, metric, cells, first, at_once):
    made, documents, asked = vectors
    index = C.build_cells(documents, new_folder(spark, "test-cells"), metric, cells)
    assert index.rows.sum() == len(made)
    found = C.search_cells(spark, index, asked, 5, first=first, at_once=at_once)
    exact = R.nearest(asked, documents, 5, metric)
    assert hit_lists(found.hits) == hit_lists(exact)
    assert set(found.rows_read) == {r["query_id"] for r in asked.selectExpr("cast(query_id as string) query_id").collect()}


def test_part_of_the_radius_reads_less_and_recalls_enough(spark, vectors):
    made, documents, asked = vectors
    index = C.build_cells(documents, new_folder(spark, "test-cells"), "l2", 60)
    whole, part = (C.search_cells(spark, index, asked, 5, reach=r, first=2) for r in (1.0, 0.3))
    want, got = hit_lists(whole.hits), hit_lists(part.hits)
    recall = sum(len(set(want[q]) & set(got.get(q, []))) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9
    assert sum(part.rows_read.values()) < sum(whole.rows_read.values()) < len(made) * len(want)


def test_probes_read_only_their_cells(spark, vectors):
    _, documents, asked = vectors
    index = C.build_cells(documents, new_folder(spark, "test-cells"), "l2", 20)
    probe = C._probe(spark, index, {3: [0], 7: [0]}, ["q"], np.zeros((1, 8)), 5)
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "(3,7)" in plan.replace(" ", "")


def test_cells_without_documents_or_questions(spark, vectors):
    _, documents, asked = vectors
    index = C.build_cells(documents.where("id < 0"), new_folder(spark, "test-cells"))
    assert C.search_cells(spark, index, asked).hits.collect() == []
    index = C.build_cells(documents, new_folder(spark, "test-cells"))
    assert C.search_cells(spark, index, asked.where("query_id < 0")).hits.collect() == []


# ---- text questions

def brute_texts(questions, documents, k):
    words = lambda t: Counter((t or "").lower().split())
    n = len(documents)
    d = Counter(w for _, t in documents for w in words(t))

    def weights(text):
        x = {w: c * math.log((n + 1) / (d[w] + 1)) for w, c in words(text).items()}
        length = math.sqrt(math.fsum(v * v for v in x.values()))
        return {w: v / length for w, v in x.items()} if length > 0 else {}

    known, out = [(i, weights(t)) for i, t in documents], []
    for q, text in questions:
        own = weights(text)
        scored = [(round(math.fsum(v * has.get(w, 0.0) for w, v in own.items()), 9), i) for i, has in known]
        ranked = sorted(((-s, i) for s, i in scored if s > 0))[:k]
        out += [(q, i, r, -s) for r, (s, i) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize(("documents", "words", "block", "at_once"), [(2048, 2_000_000, 64, 1024), (7, 2_000_000, 3, 2), (100, 60, 1, 1024)])
def test_text_questions(spark, documents, words, block, at_once):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(60)]
    prose = lambda n: " ".join("the" if rng.random() < 0.3 else vocabulary[min(59, int(rng.expovariate(0.1)))] for _ in range(n))
    texts = [None, "", " \n", "the", "the the", *[prose(rng.randint(1, 60)) for _ in range(150)]]
    texts += [texts[20].upper()] * 5  # copies
    rows = [(f"d{i:03d}", t) for i, t in enumerate(texts)]
    asked = [(f"q{i}", t) for i, t in enumerate([texts[20], texts[30], "word1 word1 unheard", "unheard", None, "the", texts[50]])]
    frame = spark.createDataFrame(rows, "id string, text string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id string, text string")
    index, spread, total = X.text_index(frame, shard_documents=documents, shard_words=words)
    found = X.search_texts(questions, index, spread, total, 5, block, at_once)
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in found.collect())
    want = sorted((q, r, i, round(s, 7)) for q, i, r, s in brute_texts(asked, rows, 5))
    assert got == want


def test_text_blocks_are_skipped():
    """On texts of several kinds a question reads some of its blocks only."""
    rng = random.Random(1)
    counts = [{**{f"k{i % 5}w{rng.randint(0, 20)}": rng.random() for _ in range(6)}, "common": 0.01 + rng.random() / 10} for i in range(500)]
    words = sorted({w for own in counts for w in own})
    triples = sorted((words.index(w), -x, d) for d, own in enumerate(counts) for w, x in own.items())
    word, weight, doc = (np.array(c) for c in zip(*triples))
    shard = X.Shard([str(d) for d in range(500)], words, doc.astype(np.int32).tobytes(), word.astype(np.int32).tobytes(), (-weight).astype(np.float64).tobytes(), 8)
    best = []
    blocks, read = shard.search(["k1w3", "k1w4", "k1w5", "common"], [0.6, 0.5, 0.4, 0.2], best, 5)
    scores = sorted((round(0.6 * c.get("k1w3", 0) + 0.5 * c.get("k1w4", 0) + 0.4 * c.get("k1w5", 0) + 0.2 * c["common"], 9) for c in counts), reverse=True)
    assert [round(s, 9) for s, _ in sorted(best, key=lambda e: -e[0])] == scores[:5] and read < blocks / 2


def test_text_questions_without_documents(spark):
    none = spark.createDataFrame([], "id string, text string")
    asked = spark.createDataFrame([("q", "word")], "query_id string, text string")
    assert X.nearest_texts(asked, none).collect() == []
    assert X.nearest_texts(asked.limit(0), spark.createDataFrame([("d", "word")], "id string, text string")).collect() == []


@pytest.mark.parametrize("documents", [2048, 9])
def test_text_vectors_span_the_leading_directions(spark, documents):
    """Against NumPy's decomposition of the whole matrix: singular values, and dot products of the best approximation."""
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(6)]
    texts = [" ".join(rng.choice(topics[i % 6]) if rng.random() < 0.9 else rng.choice(topics[rng.randint(0, 5)]) for _ in range(rng.randint(10, 50))) for i in range(120)]
    texts += ["", None]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").repartition(3)
    index, _, _ = X.text_index(frame, shard_documents=documents)
    found = {r["id"]: r["embedding"] for r in V.text_vectors(index, 6, iterations=3).collect()}
    assert len(found) == len(texts) and not np.any(found["120"]) and not np.any(found["121"])
    weights = R.term_weights(frame, "id").collect()
    words = {w: i for i, w in enumerate(sorted({r["word"] for r in weights}))}
    matrix = np.zeros((len(texts), len(words)))
    for r in weights:
        matrix[int(r["id"]), words[r["word"]]] = r["weight"]
    u, s, _ = np.linalg.svd(matrix, full_matrices=False)
    got = np.array([found[str(i)] for i in range(len(texts))], np.float64)
    assert np.allclose(np.linalg.norm(got, axis=0), s[:6], rtol=2e-3)
    best = u[:, :6] * s[:6]
    assert np.abs(got @ got.T - best @ best.T).max() < 0.02


# ---- ingest

ROWS = "TransactionID string, TransactionDate string, TransactionAmount double, Location string, Description string, DeviceID string"


def test_ingest_keeps_rows_that_differ_in_where_a_value_stands(spark):
    folder = new_folder(spark, "test-ingest")
    row = lambda description, device: ("t", "2024-01-01 10:00:00", 5.0, "N", description, device)
    first, second = spark.createDataFrame([row(None, "x")], ROWS), spark.createDataFrame([row("x", None), row(None, "x"), row("x", None)], ROWS)
    jobs.ingest(None, first, folder, "v1.0.0", "1")
    done = jobs.ingest("v1.0.0", second, folder, "v2.0.0", "2")
    assert sorted((r["Description"] or "-", r["DeviceID"] or "-") for r in done.transactions.collect()) == [("-", "x"), ("x", "-")]
    wider = second.withColumn("Channel", F.lit(None).cast("string"))  # a new column without values makes no new rows
    assert jobs.ingest("v2.0.0", wider, folder, "v3.0.0", "3").transactions.count() == 2


def test_known_rows_are_found_without_reading_parts(spark):
    folder = new_folder(spark, "test-ingest")
    rows = spark.createDataFrame([(str(i), "2024-01-01 10:00:00", float(i), "N", None, None) for i in range(20)], ROWS)
    jobs.ingest(None, rows, folder, "v1.0.0", "1")
    plan = jobs.unknown_rows(jobs.row_keys(rows), jobs.version_parts(spark, folder, "v1.0.0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "keys.parquet" in plan or "Relation [_k1" in plan
    assert "IsLargeTransaction" not in plan and "processed_transactions" not in plan
