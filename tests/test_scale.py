"""What a task holds and moves stays bounded as tables grow."""

import math
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from alertlake.functions.vectors import byte_sum
from alertlake.operators import cells as C
from alertlake.operators import retrieval as R
from alertlake.operators import text_search as X
from alertlake.operators import text_vectors as V


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(str(i), f"word{i % 7} common tail{i}") for i in range(60)], "id string, text string").coalesce(2)


def test_shards_have_row_groups_of_their_own(texts):
    """A writer holds a row group, and a reader takes one at once: shards must not gather in it."""
    index, _, total = X.text_index(texts, shard_documents=4)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")) for f in index.inputFiles()]
    assert total == 60 and sum(f.metadata.num_rows for f in files) == index.count() >= 15
    assert all(f.metadata.num_row_groups == f.metadata.num_rows for f in files)


def test_answers_reach_one_shard_at_a_time(spark, texts):
    """No list of all answers of a shard, and no stored copy of the vectors of its words."""
    shards = X.shards_of(texts, "id")
    spread = spark.createDataFrame([("common", 60)], "word string, d long")
    index = X.weigh(shards, spread, 60)
    assert "collect_list" not in plan_of(index)
    table = spark.createDataFrame([("common", [1.0, 2.0])], "word string, v array<double>")
    made = V._with_products(index, table, 2)
    assert "collect_list" not in plan_of(made) and made.columns == ["shard", "ids", "words", "doc", "word", "weight", "y"]


def test_term_weights_move_texts_and_not_their_words(spark):
    rows = [(1, "a b a"), (2, None), (1, "b c"), (None, "c d"), (None, "c e"), (3, "  "), (4, "Ä d d")]
    weights = R.term_weights(spark.createDataFrame(rows, "i int, text string"), "i")
    own = {}
    for i, text in rows:
        own.setdefault(i, Counter()).update((text or "").lower().split())
    spread, want = Counter(w for c in own.values() for w in c), set()
    for i, counts in own.items():
        x = {w: n * math.log((len(rows) + 1) / (spread[w] + 1)) for w, n in counts.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        want |= {(i, w, round(v / length, 9)) for w, v in x.items() if i is not None}
    assert weights.dtypes == [("i", "int"), ("word", "string"), ("weight", "double")]
    assert {(r["i"], r["word"], round(r["weight"], 9)) for r in weights.collect()} == want
    assert "Aggregate [i" not in plan_of(weights) and "Aggregate [_key" not in plan_of(weights)


def test_blocks_of_questions_share_a_scan(spark):
    vectors = [(str(i), [float(i % 5), float(i % 7), 1.0]) for i in range(40)]
    documents = spark.createDataFrame(vectors, "id string, embedding array<float>")
    asked = documents.select(F.col("id").alias("query_id"), "embedding")
    for metric in ("l2", "cosine"):
        together, apart = (R.nearest(asked, documents, 3, metric, n) for n in (100, 3))
        assert plan_of(apart).count("MapInArrow") == 1
        assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


def test_filters_are_judged_some_cells_at_a_time(monkeypatch):
    held, allowed = [], R._allowed

    def watched(questions, places, days):
        held.append(len(places) * len(questions.ids))
        return allowed(questions, places, days)

    monkeypatch.setattr(R, "CELLS_AT_ONCE", 100)
    monkeypatch.setattr(R, "_allowed", watched)
    rng = np.random.default_rng(1)
    vectors, places = rng.normal(size=(200, 4)), np.array(["en", "de"] * 100, dtype=object)
    asked = R.Questions([str(i) for i in range(10)], vectors[:10], ["en", "de"] * 5, np.full(10, np.datetime64("0001-01-01")), np.full(10, np.datetime64("9999-12-31")))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(200)]), pa.array(["c"] * 200), pa.array(vectors.tolist(), pa.list_(pa.float64())),
                                        pa.array(places.tolist())], names=["id", "collection", "embedding", "location"])
    best = {}
    R._consume(best, lambda: [R._Best(asked, 3, "l2")], batch, 4)
    assert max(held) <= 100 and sum(held) == 2000
    found = {(q, i) for q, _, i, _ in best["c"][0].rows("c")}
    for q in range(10):
        own = [i for i in np.argsort(np.linalg.norm(vectors - vectors[q], axis=1), kind="stable") if places[i] == places[q]][:3]
        assert {(str(q), str(i)) for i in own} <= found and len(found) == 30


def test_cells_are_found_some_distances_at_a_time(monkeypatch):
    held, distances = [], C.distances

    def watched(a, b):
        held.append(len(a) * len(b))
        return distances(a, b)

    monkeypatch.setattr(C, "distances", watched)
    rng = np.random.default_rng(2)
    vectors, centroids = rng.normal(size=(500, 8)), rng.normal(size=(40, 8))
    near, apart = C.nearest_centroids(vectors, centroids, 1000)
    whole = np.linalg.norm(vectors[:, None] - centroids[None], axis=2)
    assert (near == whole.argmin(axis=1)).all() and np.allclose(apart, whole.min(axis=1)) and max(held) <= 1000


def test_bytes_are_summed_without_a_copy():
    rows = ["", None, "aé\U0001d11e", *["x" * 2000] * 5000, ""]
    data = pa.array(rows, pa.string())
    tracemalloc.start()
    found = byte_sum.func(data).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [None if t is None else sum(t.encode()) for t in rows] and peak < data.nbytes
    assert byte_sum.func(data.slice(2, 2)).to_pylist() == [sum("aé\U0001d11e".encode()), 2000 * 120]


def test_a_refresh_keeps_equal_vectors_together(spark):
    """Rows with one vector follow each other in a file, and no sort moves rows with their vectors."""
    from alertlake.operators.summary import daily_summaries
    from alertlake.plans import jobs
    from alertlake.workspace import new_folder

    rows = spark.createDataFrame([(str(i), f"2024-01-0{1 + i % 3} 10:00:00", float(10 + i % 4), "N" * (1 + i % 2)) for i in range(200)],
                                 "TransactionID string, TransactionDate string, TransactionAmount double, Location string")
    rows = rows.withColumns({"TransactionDate": F.col("TransactionDate").cast("timestamp_ntz"), **{c: F.lit("x") for c in (
        "TransactionType", "AccountID", "MerchantID", "Channel", "DeviceID", "IPAddress", "CustomerOccupation")}, **{c: F.lit(1) for c in (
            "CustomerAge", "TransactionDuration", "LoginAttempts", "AccountBalance", "IsLargeTransaction", "IsFraud")}})
    root = new_folder(spark, "test-refresh")
    days = daily_summaries(rows)
    for run in ("1", "2"):
        stored = jobs.refresh(spark, f"{root}/vectors", rows, days, f"{root}/alerts", run)
    assert stored.where(F.col("collection") == "transactions").count() == 200 and stored.count() == 200 + days.count()
    for file in stored.where(F.col("collection") == "transactions").inputFiles():
        table = pq.read_table(file.replace("%3D", "=").removeprefix("file:").replace("///", "/"), columns=["text"], partitioning=None)
        seeds = [sum(t.encode()) for t in table.column("text").to_pylist()]
        assert seeds == sorted(seeds)


def test_distinct_numbers_are_those_of_numpy():
    from alertlake.llm.ngram_lm import distinct

    rng = np.random.default_rng(4)
    for values in (np.zeros(0, np.uint64), rng.integers(0, 50, 500).astype(np.uint64) << np.uint64(50), np.array([2**64 - 1, 0, 2**64 - 2, 0], np.uint64)):
        numbers, which = distinct(values)
        want, places = np.unique(values, return_inverse=True)
        assert numbers.dtype == np.uint64 and (numbers == want).all() and (which == places).all()


def test_memories_of_packing_have_the_room_they_are_given():
    from alertlake.llm.packing import ENTRY, Recent

    held = Recent(lambda key: key, 100 * (8 + ENTRY))
    assert [held[b"%04d" % i] for i in range(1000)] == [b"%04d" % i for i in range(1000)] and len(held) + len(held.older) <= 101


def test_an_index_takes_few_bytes_an_entry(spark):
    """A number of documents and words in full, and a weight of eight bytes, took 16 bytes an entry, several times the text's own size on disk."""
    rng = np.random.default_rng(8)
    rows = [(str(i), " ".join(f"w{n}" for n in rng.zipf(1.3, 300) if n < 20000)) for i in range(300)]
    index, _, _ = X.text_index(spark.createDataFrame(rows, "id string, text string").coalesce(1))
    entries = sum(len(set(t.split())) for _, t in rows)
    assert sum(len(r[c]) for r in index.collect() for c in ("doc", "word", "weight")) < 6 * entries
    got = {(r["i"], r["word"]): r["weight"] for r in X.entries(index, "i", "word").collect()}
    spread = Counter(w for _, t in rows for w in set(t.split()))
    for i, t in rows[:50]:
        x = {w: n * math.log((len(rows) + 1) / (spread[w] + 1)) for w, n in Counter(t.split()).items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        assert all(abs(got[i, w] - v / length) < 1e-12 for w, v in x.items())
    assert len(got) == entries


@pytest.mark.parametrize("kind", ["<i4", "<i8"])
def test_packed_numbers_come_back(kind):
    for values in ([], [0], [5, -1, 0, 2**31 - 1, -(2**31)], list(range(1000))):
        found = X.unpacked(X.packed(np.array(values, np.int64), kind), kind)
        assert found.dtype == np.dtype(kind) and found.tolist() == values


def test_rows_of_a_document_that_come_in_parts_are_one(spark, monkeypatch):
    monkeypatch.setattr(X, "COUNTED_AT_ONCE", 4)
    rows = [(1, "a b a"), (1, "c"), (1, "a  B d e f"), (2, ""), (2, None), (3, "x"), (3, "y x"), (4, "a")]
    shards = X.shards_of(spark.createDataFrame(rows, "i int, text string").coalesce(1), "i", shard_documents=3, id_type="int", grouped=True).collect()
    assert [r["ids"] for r in shards] == [[1, 2, 3], [4]]
    doc, word = X.places_of(shards[0]["doc"], shards[0]["word"])
    got = {(int(d), shards[0]["words"][w]): int(n) for d, w, n in zip(doc, word, X.unpacked(shards[0]["n"]))}
    assert got == {(0, "a"): 3, (0, "b"): 2, (0, "c"): 1, (0, "d"): 1, (0, "e"): 1, (0, "f"): 1, (2, "x"): 2, (2, "y"): 1}
    assert dict(zip(shards[0]["words"], shards[0]["spread"])) == dict.fromkeys("abcdefxy", 1)


def test_questions_of_all_partitions_share_a_scan(spark, texts):
    """A block of questions was what one partition had of them, searched question by question in every shard."""
    index, spread, total = X.text_index(texts)
    asked = texts.select(F.col("id").alias("query_id"), "text").repartition(12)
    assert plan_of(X.search_texts(asked, index, spread, total)).count("MapInArrow") == 1


@pytest.mark.parametrize(("columns", "shared_by", "products", "documents"), [(1024, 16, 1_000_000, 512), (3, 2, 7, 4), (0, 1, 50, 64)])
def test_products_of_many_questions(monkeypatch, columns, shared_by, products, documents):
    for name, value in (("COLUMNS", columns), ("SHARED_BY", shared_by), ("PRODUCTS_AT_ONCE", products)):
        monkeypatch.setattr(X, name, value)
    rng = np.random.default_rng(3)
    a, q = (np.where(rng.random(shape) < 0.3, rng.random(shape), 0.0) for shape in ((40, 30), (9, 30)))
    a[20:30] = a[3]  # copies
    question, word = np.nonzero(q)
    asked = X.Asked([f"q{i}" for i in range(9)], [f"w{i}" for i in range(30)], question, word, q[question, word])
    best, limits, ids = [[] for _ in range(9)], np.zeros(9), pa.array([f"d{i:02d}" for i in range(40)])
    for at in range(0, 40, documents):
        doc, place = np.nonzero(a[at : at + documents])
        scores = asked.scores(doc, place, a[at : at + documents][doc, place], len(a[at : at + documents]))
        assert np.allclose(scores, a[at : at + documents] @ q.T)
        X._keep(best, limits, scores, ids.slice(at, documents), 5)
    for i in range(9):
        want = sorted((-round(float(a[d] @ q[i]), 9), f"d{d:02d}") for d in range(40) if a[d] @ q[i] > 0)[:5]
        assert [h[1] for h in best[i]] == [h[1] for h in want] and np.allclose([h[0] for h in best[i]], [h[0] for h in want])


def test_shuffle_files_go_once_a_table_is_written(spark):
    from alertlake.workspace import CLEANUP_KEY, store

    def shuffled() -> set[str]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "shuffle_" in f}

    before, set_before = shuffled(), spark.conf.get(CLEANUP_KEY)
    sums = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count()
    stored = store(sums, "test-tidy", tidy=True)
    for _ in range(100):  # they go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and len(stored.collect()) == 100
    assert spark.conf.get(CLEANUP_KEY) == set_before and len(sums.collect()) == 100
