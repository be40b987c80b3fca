"""Registered queries of vectors, retrieval, contexts and prompts. Questions are all vectors whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertlake.functions.text import PROMPTS
from alertlake.functions.vectors import byte_sum, dot, hash_embedding
from alertlake.operators import cells as C
from alertlake.operators import drift
from alertlake.operators import retrieval as R
from alertlake.operators import text_search as X
from alertlake.operators import text_vectors as V
from alertlake.plans import jobs
from alertlake.plans.catalog import query
from alertlake.plans.views import order_summaries, table, txn_events
from alertlake.operators.sizing import spread_small
from alertlake.operators.summary import daily_summaries
from alertlake.sources import sinks
from alertlake.workspace import new_folder, store


def documents(spark, folder):
    """Every document with text and metadata, and one of the vectors: there are fewer vectors, which repeat in the order of the ids."""
    vectors = table(spark, folder, "embeddings")
    number = vectors.agg(F.max("vec_id") + 1).first()[0]
    texts = table(spark, folder, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return texts.join(vectors, F.col("doc_id") % number == vectors["vec_id"]).select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("label") % 2 == 0, "transactions").otherwise("summaries").alias("collection"),
        "text", "embedding", F.col("lang").alias("location"), day.alias("date"),
        F.struct(F.col("doc_id").alias("id"), day.cast("string").alias("date"), F.col("lang").alias("location"), F.col("source").alias("type"),
                 F.col("n_chars").cast("string").alias("amount"), F.col("label").alias("label")).alias("metadata"))


def questions(spark, folder):
    """Every vector whose id is divisible by 100 as a question, with a place, a second place and a period."""
    number = F.expr("vec_id div 100")
    place = F.when(number % 2 == 0, "en").otherwise("de")
    other = F.when(number % 3 == 0, "fr").otherwise("es")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (number % 20).cast("int"))
    return table(spark, folder, "embeddings").where(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").cast("string").alias("query_id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("query"),
        "embedding", place.alias("branch"), other.alias("compare_with"), start.alias("start_date"), F.date_add(start, 10).alias("end_date"),
        F.element_at(F.array(*[F.lit(k) for k in ("general", "branch", "fraud", "comparison", "trend")]), (number % 5).cast("int") + 1).alias("alert_type"),
        F.lit("last month").alias("timeframe"))


DOCUMENTS = """(
    SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN label % 2 = 0 THEN 'transactions' ELSE 'summaries' END AS collection, text,
           CAST(embedding AS DOUBLE[]) AS embedding, lang AS location, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS date,
           source, n_chars, label
    FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT max(vec_id) + 1 FROM embeddings))"""
QUESTIONS = """(
    SELECT CAST(vec_id AS VARCHAR) AS query_id, 'vector ' || vec_id AS query, CAST(embedding AS DOUBLE[]) AS embedding,
           CASE WHEN n % 2 = 0 THEN 'en' ELSE 'de' END AS branch, CASE WHEN n % 3 = 0 THEN 'fr' ELSE 'es' END AS compare_with,
           CAST(DATE '2024-01-01' + CAST(n % 20 AS INTEGER) AS DATE) AS start_date, CAST(DATE '2024-01-01' + CAST(n % 20 AS INTEGER) + 10 AS DATE) AS end_date,
           n % 5 AS kind
    FROM (SELECT *, vec_id // 100 AS n FROM embeddings WHERE vec_id % 100 = 0))"""


def hits_sql(k, where="true", side="branch", only="true"):
    return f"""(
    SELECT * FROM (SELECT q.query_id, q.branch, q.compare_with, q.start_date, q.end_date, d.collection, d.id, d.text, d.location, d.date,
                          d.source, d.n_chars, d.label, list_cosine_distance(q.embedding, d.embedding) AS distance,
                          ROW_NUMBER() OVER (PARTITION BY q.query_id, d.collection
                              ORDER BY round(list_cosine_distance(q.embedding, d.embedding), 9), d.id) AS rank
                   FROM {QUESTIONS} q, {DOCUMENTS} d WHERE ({where}) AND ({only})) WHERE rank <= {k})"""


HIT_COLUMNS = "query_id, collection, id, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance"


def hit_rows(hits):
    return hits.select("query_id", "collection", "id", "rank", F.round("distance", 5).alias("distance"))


@query("emb_hash_seed", """
    SELECT doc_id, CAST(list_sum(list_transform(string_split(text, ''), lambda c: CASE
        WHEN unicode(c) < 128 THEN unicode(c)
        WHEN unicode(c) < 2048 THEN 320 + (unicode(c) >> 6) + (unicode(c) & 63)
        WHEN unicode(c) < 65536 THEN 480 + (unicode(c) >> 12) + ((unicode(c) >> 6) & 63) + (unicode(c) & 63)
        ELSE 624 + (unicode(c) >> 18) + ((unicode(c) >> 12) & 63) + ((unicode(c) >> 6) & 63) + (unicode(c) & 63) END)) AS BIGINT) AS seed
    FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, 0 FROM documents WHERE length(text) = 0""")
def emb_hash_seed(spark, folder):
    return table(spark, folder, "documents").select("doc_id", byte_sum(F.col("text")).alias("seed"))


@query("emb_hash", "SELECT doc_id, 384 AS dimensions, CAST(1 AS DOUBLE) AS norm, TRUE AS one_per_seed FROM documents")
def emb_hash(spark, folder):
    """Vectors of all texts: their length, their norm, and whether texts of one seed share a vector."""
    texts = spread_small(table(spark, folder, "documents").select("doc_id", "text"))
    made = texts.select("doc_id", byte_sum(F.col("text")).alias("seed"), hash_embedding(F.col("text")).alias("embedding"))
    shown = store(made.select("doc_id", "seed", F.size("embedding").alias("dimensions"),
                              F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"), F.xxhash64("embedding").alias("print")), "vectors")
    same = shown.groupBy("seed").agg((F.min("print") == F.max("print")).alias("one_per_seed"))
    return shown.join(same, "seed").select("doc_id", "dimensions", "norm", "one_per_seed")


WORDS = "(SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents)"


@query("emb_tfidf", f"""
    WITH c AS (SELECT doc_id, word, COUNT(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1, 2),
         d AS (SELECT word, COUNT(*) AS d FROM c GROUP BY 1),
         x AS (SELECT doc_id, word, n * ln(((SELECT COUNT(*) FROM documents) + 1) / (d + 1)) AS x FROM c JOIN d USING (word)),
         l AS (SELECT doc_id, sqrt(SUM(x * x)) AS l FROM x GROUP BY 1)
    SELECT doc_id, word, round(CASE WHEN l > 0 THEN x / l ELSE 0 END, 6) AS weight FROM x JOIN l USING (doc_id)""")
def emb_tfidf(spark, folder):
    """The weight of every distinct word of every text."""
    weights = R.term_weights(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return weights.select("doc_id", "word", F.round("weight", 6).alias("weight"))


@query("emb_tfidf_hashed", f"""
    SELECT doc_id, COUNT(DISTINCT word) FILTER (WHERE word <> '') > 0 AS has_words, TRUE AS unit FROM {WORDS} GROUP BY 1""")
def emb_tfidf_hashed(spark, folder):
    """Hashed weights of all texts, as the filled places of sparse vectors: whether there are any, and that the length is 1."""
    texts = table(spark, folder, "documents").select("doc_id", "text")
    lengths = R.term_weights(texts, "doc_id", places=1 << 12).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("l"))
    return texts.select("doc_id").join(lengths, "doc_id", "left").select(
        "doc_id", F.col("l").isNotNull().alias("has_words"), F.coalesce(F.abs(F.col("l") - 1) < 1e-9, F.lit(True)).alias("unit"))


@query("embed_hook", "SELECT doc_id, length(text) AS chars, length(replace(text, 'e', '')) AS without_e FROM documents")
def embed_hook(spark, folder):
    """Vectors of all texts from a function of one's own."""
    def measure(texts):
        return [(float(len(t)), float(len(t.replace("e", "")))) for t in texts]

    made = R.embed_with(table(spark, folder, "documents").select("doc_id", "text"), measure)
    return made.select("doc_id", F.col("embedding")[0].cast("bigint").alias("chars"), F.col("embedding")[1].cast("bigint").alias("without_e"))


@query("emb_table", f"SELECT collection, COUNT(*) AS vectors, COUNT(DISTINCT id) AS ids, 64 AS dimensions FROM {DOCUMENTS} GROUP BY 1")
def emb_table(spark, folder):
    """The vector table written by collection and read back."""
    path = new_folder(spark, "embeddings")
    sinks.save_embeddings(documents(spark, folder).select("collection", "id", "text", "embedding", "metadata"), path)
    return spark.read.parquet(path).groupBy("collection").agg(
        F.count(F.lit(1)).alias("vectors"), F.count_distinct("id").alias("ids"), F.max(F.size("embedding")).alias("dimensions"))


@query("emb_add_new_only", f"""
    SELECT id, collection FROM {DOCUMENTS} WHERE location <> 'en'""")
def emb_add_new_only(spark, folder):
    """Every document offered twice to a store that holds the English ones."""
    offered = documents(spark, folder).select("collection", "id", "text", "location")
    held = offered.where(F.col("location") == "en")
    return sinks.new_only(held, offered.union(offered)).select("id", "collection")


@query("emb_sample", """
    SELECT LEAST(COUNT(*), 1000) AS vectors, LEAST(COUNT(*), 1000) AS ids, '2024-01-31' AS taken FROM embeddings""")
def emb_sample(spark, folder):
    """The monitoring sample: at most 1000 vectors, stored under its time and read back as the latest."""
    path = new_folder(spark, "samples")
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    for day in ("2024-01-30", "2024-01-31"):
        drift.save_sample(vectors, path, day)
    latest = drift.load_sample(spark, path)
    return latest.groupBy("taken").agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("id").alias("ids"))


@query("knn_exact", f"""
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance FROM (
        SELECT q.query_id, d.id, list_cosine_distance(q.embedding, d.embedding) AS distance, ROW_NUMBER() OVER (PARTITION BY q.query_id
               ORDER BY round(list_cosine_distance(q.embedding, d.embedding), 9), d.id) AS rank FROM {QUESTIONS} q, {DOCUMENTS} d)
    WHERE rank <= 5""")
def knn_exact(spark, folder):
    hits = R.nearest(questions(spark, folder).select("query_id", "embedding"), documents(spark, folder).drop("collection"))
    return hit_rows(hits).drop("collection")


@query("knn_l2", f"""
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance FROM (
        SELECT q.query_id, d.id, list_distance(q.embedding, d.embedding) AS distance, ROW_NUMBER() OVER (PARTITION BY q.query_id
               ORDER BY round(list_distance(q.embedding, d.embedding), 9), d.id) AS rank FROM {QUESTIONS} q, {DOCUMENTS} d)
    WHERE rank <= 5""")
def knn_l2(spark, folder):
    """The other distance, with the questions in several blocks."""
    hits = R.nearest(questions(spark, folder).select("query_id", "embedding"), documents(spark, folder).drop("collection"), metric="l2", at_once=3)
    return hit_rows(hits).drop("collection")


@query("knn_lsh", f"""
    SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance FROM (
        SELECT q.query_id, d.id, list_cosine_distance(q.embedding, d.embedding) AS distance, ROW_NUMBER() OVER (PARTITION BY q.query_id
               ORDER BY round(list_cosine_distance(q.embedding, d.embedding), 9), d.id) AS rank FROM {QUESTIONS} q, {DOCUMENTS} d)
    WHERE rank <= 5""")
def knn_lsh(spark, folder):
    """Hits from cells: documents are written by their nearest centroid, and a question reads the cells that can hold one of its five nearest."""
    index = C.build_cells(documents(spark, folder).select("id", "embedding"), new_folder(spark, "cells"))
    hits = C.search_cells(spark, index, questions(spark, folder).select("query_id", "embedding")).hits
    return hits.select("query_id", "id", "rank", F.round("distance", 5).alias("distance"))


WEIGHTS = f"""
    WITH c AS (SELECT doc_id, word, COUNT(*) AS n FROM {WORDS} WHERE word <> '' GROUP BY 1, 2),
         d AS (SELECT word, COUNT(*) AS d FROM c GROUP BY 1),
         x AS (SELECT doc_id, word, n * ln(((SELECT COUNT(*) FROM documents) + 1) / (d + 1)) AS x FROM c JOIN d USING (word)),
         l AS (SELECT doc_id, sqrt(SUM(x * x)) AS l FROM x GROUP BY 1),
         w AS (SELECT doc_id, word, x / l AS w FROM x JOIN l USING (doc_id) WHERE l > 0),
         s AS (SELECT q.doc_id AS query_id, t.doc_id AS id, round(SUM(q.w * t.w), 9) AS score FROM w q JOIN w t USING (word) WHERE q.doc_id % 100 = 0 GROUP BY 1, 2),
         r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(id AS VARCHAR)) AS rank FROM s WHERE score > 0)"""


def text_questions(spark, folder):
    """The whole texts of documents whose id is divisible by 100."""
    docs = table(spark, folder, "documents")
    return docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"), docs.select(F.col("doc_id").alias("id"), "text")


@query("knn_text", f"""{WEIGHTS} SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(id AS VARCHAR) AS id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score
    FROM r WHERE rank <= 5""")
def knn_text(spark, folder):
    """The five documents most similar to each text question by term weights, itself included."""
    return X.nearest_texts(*text_questions(spark, folder)).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@query("ctx_text", f"""{WEIGHTS}, t AS (SELECT query_id, list(substring(text, 1, 2000) ORDER BY rank) AS texts FROM r JOIN documents ON doc_id = id
        WHERE rank <= 5 AND regexp_matches(text, '\\S') GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS query_id, '### RETRIEVED CONTEXT:' || chr(10) || chr(10) || {{NUMBERED}} || chr(10) || chr(10) AS context
    FROM (SELECT doc_id, COALESCE(texts, ['{R.NOTHING_FOUND}']) AS texts FROM documents LEFT JOIN t ON query_id = doc_id WHERE doc_id % 100 = 0)""".replace(
        "{NUMBERED}", "array_to_string(list_transform(range(1, len(texts) + 1), lambda i: 'Document ' || i || ':' || chr(10) || texts[i]), chr(10) || chr(10))"))
def ctx_text(spark, folder):
    """The context of every text question."""
    asked, docs = text_questions(spark, folder)
    hits = X.nearest_texts(asked, docs).withColumn("collection", F.lit(R.COLLECTIONS[0]))
    found = R.retrieved_texts(asked.select(F.col("query_id").cast("string").alias("query_id")), R.with_documents(hits, docs))
    return found.select("query_id", R.query_context(F.col("texts")).alias("context"))


@query("knn_text_dense")
def knn_text_dense(spark, folder):
    """The five texts nearest to each text question by dense vectors of all texts, found through cells."""
    asked, docs = text_questions(spark, folder)
    vectors = store(V.text_vectors(X.text_index(docs)[0]), "dense")
    index = C.build_cells(vectors, new_folder(spark, "dense-cells"))
    questions_ = vectors.join(asked.select(F.col("query_id").cast("string").alias("id")), "id").withColumnRenamed("id", "query_id")
    return C.search_cells(spark, index, questions_).hits.select("query_id", "id", "rank", F.round("distance", 3).alias("distance"))


PLACE = "d.location = q.branch"
PERIOD = "d.date BETWEEN q.start_date AND q.end_date"


@query("knn_filtered", f"SELECT {HIT_COLUMNS} FROM {hits_sql(5, PLACE + ' AND ' + PERIOD)}")
def knn_filtered(spark, folder):
    asked = questions(spark, folder).select("query_id", "embedding", F.col("branch").alias("location"), "start_date", "end_date")
    return hit_rows(R.nearest(asked, documents(spark, folder)))


@query("knn_per_collection", f"SELECT {HIT_COLUMNS} FROM {hits_sql(5)}")
def knn_per_collection(spark, folder):
    return hit_rows(R.nearest(questions(spark, folder).select("query_id", "embedding"), documents(spark, folder)))


@query("knn_location", f"SELECT {HIT_COLUMNS} FROM {hits_sql(10, PLACE)}")
def knn_location(spark, folder):
    asked = questions(spark, folder).select("query_id", "embedding", F.col("branch").alias("location"))
    return hit_rows(R.nearest(asked, documents(spark, folder), 10))


@query("knn_date_range", f"SELECT {HIT_COLUMNS} FROM {hits_sql(5, PERIOD)}")
def knn_date_range(spark, folder):
    return hit_rows(R.nearest(questions(spark, folder).select("query_id", "embedding", "start_date", "end_date"), documents(spark, folder)))


ITEM = ("'--- Item ' || rank || ' ---' || chr(10) || 'date: ' || date || chr(10) || 'location: ' || location || chr(10) || 'type: ' || source "
        "|| chr(10) || 'amount: ' || n_chars || chr(10) || 'label: ' || label || chr(10) || text || chr(10) || chr(10)")


def items_sql(hits):
    return f"(SELECT query_id, collection, string_agg({ITEM}, '' ORDER BY rank) AS context FROM {hits} GROUP BY 1, 2)"


def texts_sql(k):
    return f"""(
    SELECT query_id, list(substring(text, 1, 2000) ORDER BY CASE collection WHEN 'transactions' THEN 0 ELSE 1 END, rank) AS texts
    FROM {hits_sql(k)} WHERE regexp_matches(text, '\\S') GROUP BY 1)"""


def numbered_sql(label, between):
    return (f"array_to_string(list_transform(range(1, len(texts) + 1), lambda i: '{label} ' || i || ':' || chr(10) || texts[i]), {between})")


@query("ctx_format", f"SELECT query_id, collection, context FROM {items_sql(hits_sql(5))}")
def ctx_format(spark, folder):
    docs = documents(spark, folder)
    return R.item_context(R.with_documents(R.nearest(questions(spark, folder).select("query_id", "embedding"), docs), docs))


@query("ctx_retrieve", f"""
    SELECT query_id, CAST(i AS INTEGER) AS position, texts[i] AS text FROM (SELECT query_id, texts, unnest(range(1, len(texts) + 1)) AS i FROM {texts_sql(5)})""")
def ctx_retrieve(spark, folder):
    found = R.retrieve(questions(spark, folder), documents(spark, folder))
    return found.select("query_id", F.posexplode("texts").alias("position", "text")).withColumn("position", F.col("position") + 1)


CONTEXT_SQL = f"""
    SELECT query_id, '### RETRIEVED CONTEXT:' || chr(10) || chr(10) || {numbered_sql('Document', 'chr(10) || chr(10)')} || chr(10) || chr(10) AS context
    FROM {texts_sql(5)}"""


@query("ctx_query", CONTEXT_SQL)
def ctx_query(spark, folder):
    found = R.retrieve(questions(spark, folder), documents(spark, folder))
    return found.select("query_id", R.query_context(F.col("texts")).alias("context"))


def sides_sql(hits, title):
    return f"""
    SELECT q.query_id, 'TRANSACTION DETAILS ' || {title} || ':' || chr(10) || COALESCE(t.context, '') || chr(10) || chr(10)
           || 'BRANCH SUMMARIES ' || {title} || ':' || chr(10) || COALESCE(s.context, '') AS context
    FROM {QUESTIONS} q LEFT JOIN (SELECT * FROM {items_sql(hits)} WHERE collection = 'transactions') t ON t.query_id = q.query_id
         LEFT JOIN (SELECT * FROM {items_sql(hits)} WHERE collection = 'summaries') s ON s.query_id = q.query_id"""


BRANCH_SQL = sides_sql(hits_sql(5, PLACE), "'FOR ' || q.branch")


@query("ctx_branch", BRANCH_SQL)
def ctx_branch(spark, folder):
    return R.branch_context(questions(spark, folder), documents(spark, folder)).select("query_id", "context")


PERIOD_SQL = sides_sql(hits_sql(5, PLACE + " AND " + PERIOD), "'from ' || q.start_date || ' to ' || q.end_date || ' for ' || q.branch")


@query("ctx_date_range", PERIOD_SQL)
def ctx_date_range(spark, folder):
    return R.date_range_context(questions(spark, folder), documents(spark, folder)).select("query_id", "context")


COMPARE_SQL = f"""
    SELECT q.query_id, COALESCE(a.context, '') AS branch_a_context, COALESCE(b.context, '') AS branch_b_context
    FROM {QUESTIONS} q LEFT JOIN {items_sql(hits_sql(5, PLACE, only="d.collection = 'summaries'"))} a ON a.query_id = q.query_id
         LEFT JOIN {items_sql(hits_sql(5, "d.location = q.compare_with", only="d.collection = 'summaries'"))} b ON b.query_id = q.query_id"""


@query("ctx_compare", COMPARE_SQL)
def ctx_compare(spark, folder):
    found = R.comparison_context(questions(spark, folder), documents(spark, folder))
    return found.select("query_id", "branch_a_context", "branch_b_context")


@query("ctx_augment", f"""
    SELECT t.query_id, 'Query: ' || q.query || chr(10) || chr(10) || 'Retrieved Context:' || chr(10)
           || {numbered_sql('Context', 'chr(10) || chr(10)')} || chr(10) || chr(10) || 'Additional Context:' || chr(10) || q.branch || chr(10) || chr(10)
           AS augmented FROM {texts_sql(5)} t JOIN {QUESTIONS} q USING (query_id)""")
def ctx_augment(spark, folder):
    found = R.retrieve(questions(spark, folder), documents(spark, folder))
    return found.select("query_id", R.augmented_query(F.col("query"), F.col("texts"), F.col("branch")).alias("augmented"))


def pattern_sql(pattern, values):
    """The concatenation that fills a prompt pattern."""
    parts = []
    for i, piece in enumerate(pattern.replace("}", "{").split("{")):
        if piece:
            parts.append(values[piece] if i % 2 else "'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


def prompts_sql(of):
    """Prompts of all questions; ``of(kind, number)`` says in SQL which of them are of the kind."""
    open_ended = f"(SELECT query_id, context FROM ({CONTEXT_SQL}))"
    rows = [
        ("general", f"{QUESTIONS} q JOIN {open_ended} c USING (query_id)", {"query": "q.query", "context": "c.context"}),
        ("branch", f"{QUESTIONS} q JOIN ({BRANCH_SQL}) c USING (query_id)",
         {"branch": "q.branch", "time_period": "'last month'", "context": "c.context"}),
        ("fraud", f"{QUESTIONS} q JOIN {open_ended} c USING (query_id)", {"context": "c.context"}),
        ("comparison", f"{QUESTIONS} q JOIN ({COMPARE_SQL}) c USING (query_id)",
         {"time_period": "'last month'", "branch_a_context": "c.branch_a_context", "branch_b_context": "c.branch_b_context"}),
        ("trend", f"{QUESTIONS} q JOIN ({PERIOD_SQL}) c USING (query_id)",
         {"time_period": "q.start_date || ' to ' || q.end_date || ' for ' || q.branch", "context": "c.context"}),
    ]
    return " UNION ALL ".join(
        f"SELECT {of(kind, i)[0]} AS query_id, '{kind}' AS alert_type, {pattern_sql(PROMPTS[kind], values)} AS prompt FROM {source} {of(kind, i)[1]}"
        for i, (kind, source, values) in enumerate(rows))


@query("prompt_batch", prompts_sql(lambda kind, i: (f"q.query_id || '-{kind}'", "")))
def prompt_batch(spark, folder):
    """Every question as each of the five kinds of request."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("general", "branch", "fraud", "comparison", "trend")]))
    asked = questions(spark, folder).withColumn("alert_type", kinds).withColumn("query_id", F.concat_ws("-", "query_id", "alert_type"))
    return R.prompts(asked, documents(spark, folder)).select("query_id", "alert_type", "prompt")


@query("prompt_by_type", prompts_sql(lambda kind, i: ("q.query_id", f"WHERE q.kind = {i}")))
def prompt_by_type(spark, folder):
    """Every question as the one kind it is."""
    return R.prompts(questions(spark, folder), documents(spark, folder)).select("query_id", "alert_type", "prompt")


@query("refresh_job", """
    SELECT 'transactions' AS collection, COUNT(*) AS vectors FROM events UNION ALL
    SELECT 'summaries', COUNT(*) FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) FROM events)""")
def refresh_job(spark, folder):
    """Refresh twice; the second run finds nothing to add."""
    root = new_folder(spark, "refresh")
    rows = txn_events(spark, folder)
    days = daily_summaries(rows)
    for run in ("20240131000000", "20240201000000"):
        stored = jobs.refresh(spark, f"{root}/vectors", rows, days, f"{root}/alerts", run)
    return stored.groupBy("collection").agg(F.count(F.lit(1)).alias("vectors"))
