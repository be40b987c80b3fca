import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlake.functions.vectors import hash_embedding
from alertlake.operators import retrieval as R


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(3)
    vectors = rng.randn(600, 16).astype(np.float32)
    vectors[400:600] = vectors[7]  # a third of all documents are copies
    rows = [(f"d{i:03d}", ["transactions", "summaries"][i % 2], [float(x) for x in v], ["N", "S", "E"][i % 3], f"2024-01-{i % 28 + 1:02d}", f"text {i}")
            for i, v in enumerate(vectors)]
    documents = spark.createDataFrame(rows, "id string, collection string, embedding array<float>, location string, date string, text string").withColumn(
        "date", F.to_date("date")).repartition(5)
    questions = rng.randn(7, 16)
    questions[0] = vectors[7]
    asked = spark.createDataFrame([(f"q{i}", [float(x) for x in v], ["N", "S", None][i % 3], "2024-01-05", "2024-01-20") for i, v in enumerate(questions)],
                                  "query_id string, embedding array<double>, location string, start_date string, end_date string")
    return rows, documents.cache(), questions, asked.cache()


def brute(rows, questions, k, metric, keep=lambda q, r: True):
    out = {}
    for q, vector in enumerate(questions):
        for collection in ("transactions", "summaries"):
            scored = []
            for r in rows:
                if r[1] == collection and keep(q, r):
                    v = np.array(r[2])
                    d = 1 - v @ vector / np.sqrt((v @ v) * (vector @ vector)) if metric == "cosine" else np.sqrt(((v - vector) ** 2).sum())
                    scored.append((round(float(d), 9), r[0]))
            out[f"q{q}", collection] = [i for _, i in sorted(scored)[:k]]
    return {key: ids for key, ids in out.items() if ids}


def result(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault((r["query_id"], r["collection"]), []).append(r["id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("at_once", [100, 3])
def test_exact(data, metric, at_once):
    rows, documents, questions, asked = data
    hits = R.nearest(asked.select("query_id", "embedding"), documents, 5, metric, at_once)
    assert result(hits) == brute(rows, questions, 5, metric)


@pytest.mark.parametrize("at_once", [100, 3])
def test_filters(data, at_once):
    rows, documents, questions, asked = data
    places = ["N", "S", None, "N", "S", None, "N"]
    want = brute(rows, questions, 4, "cosine", lambda q, r: places[q] in (None, r[3]) and "2024-01-05" <= r[4] <= "2024-01-20")
    assert result(R.nearest(asked, documents, 4, at_once=at_once)) == want


def test_hashed_finds_most_and_only_true_distances(data):
    rows, documents, questions, asked = data
    exact = result(R.nearest(asked.select("query_id", "embedding"), documents, 5))
    near = R.nearest_hashed(asked.select("query_id", "embedding"), documents, 16, 5, length=4.0)
    found = result(near)
    true = {(r["query_id"], r["id"]): r["distance"] for r in R.nearest(asked.select("query_id", "embedding"), documents, 600).collect()}
    assert all(abs(true[r["query_id"], r["id"]] - r["distance"]) < 1e-6 for r in near.collect())
    hit = sum(len(set(found.get(key, [])) & set(ids)) for key, ids in exact.items()) / sum(len(ids) for ids in exact.values())
    assert hit > 0.8


def test_no_questions(data):
    _, documents, _, asked = data
    assert R.nearest(asked.where("query_id = 'none'"), documents).count() == 0


def test_hash_embedding_is_the_seeded_generator(spark):
    texts = ["", "abc", "cba", "Zürich", "x" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["v"] for r in df.select("i", hash_embedding(F.col("t")).alias("v")).orderBy("i").collect()]
    for text, vector in zip(texts, got):
        want = np.random.RandomState(sum(text.encode())).rand(384)
        assert np.allclose(vector, want / np.sqrt((want ** 2).sum()), atol=1e-7)
    assert got[1] == got[2]
    assert sum("Zürich".encode()) == 895


def test_context_texts(spark):
    docs = spark.createDataFrame([("a", "transactions", [1.0, 0.0], "alpha"), ("b", "summaries", [1.0, 0.1], "beta"), ("c", "transactions", [0.9, 0.0], "  ")],
                                 "id string, collection string, embedding array<double>, text string")
    asked = spark.createDataFrame([("q", "why", [1.0, 0.0]), ("none", "what", None)], "query_id string, query string, embedding array<double>")
    rows = {r["query_id"]: r for r in R.retrieve(asked, docs).withColumns({
        "c": R.query_context(F.col("texts")), "a": R.augmented_query(F.col("query"), F.col("texts"), F.lit("more"))}).collect()}
    assert rows["q"]["texts"] == ["alpha", "beta"] and rows["none"]["texts"] == ["No specific data found for this query."]
    assert rows["q"]["c"] == "### RETRIEVED CONTEXT:\n\nDocument 1:\nalpha\n\nDocument 2:\nbeta\n\n"
    assert rows["q"]["a"] == "Query: why\n\nRetrieved Context:\nContext 1:\nalpha\n\nContext 2:\nbeta\n\nAdditional Context:\nmore\n\n"


def test_embed_hook_and_weights(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "b c d")], "i int, text string")
    rows = R.embed_with(df, lambda texts: [[float(len(t)), 1.0] for t in texts]).orderBy("i").collect()
    assert [r["embedding"] for r in rows] == [[3.0, 1.0], [0.0, 1.0], [5.0, 1.0]]
    for places in (None, 64):
        weights = R.term_weights(df, "i", places=places).collect()
        for i, words in ((1, 2), (3, 3)):
            own = [r["weight"] for r in weights if r["i"] == i]
            assert len(own) <= words and sum(w * w for w in own) == pytest.approx(1.0)
        assert {r["i"] for r in weights} == {1, 3}


def test_mistakes_are_reported(spark, data):
    _, documents, _, asked = data
    with pytest.raises(ValueError):
        R.nearest(asked, documents.drop("location"))
    with pytest.raises(ValueError):
        R.nearest(asked.drop("location"), documents.drop("date"))
    short = documents.withColumn("embedding", F.slice("embedding", 1, 3))
    for at_once in (100, 3):
        with pytest.raises(Exception, match="expected 16 dimensions"):
            R.nearest(asked.select("query_id", "embedding"), short, at_once=at_once).collect()
    with pytest.raises(Exception, match="expected 16 dimensions"):
        R.nearest_hashed(asked.select("query_id", "embedding"), short, 16).collect()
    with pytest.raises(ValueError, match="dimensions"):
        R.nearest(asked.withColumn("embedding", F.when(F.col("query_id") == "q1", F.array(F.lit(1.0))).otherwise(F.col("embedding"))), documents)


def test_texts_stay_in_place(spark, data):
    """Hits travel to the texts: no exchange above the scan of the texts, even if texts are larger than what is broadcast by size."""
    from alertlake.workspace import store

    _, documents, _, asked = data
    texts = store(documents.withColumn("text", F.repeat("text", 500)), "texts")
    hits = store(R.nearest(asked.select("query_id", "embedding"), texts), "hits")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60k")
    try:
        plan = hits.join(texts.select("id", "collection", "text"), ["id", "collection"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
