"""Batch top-k retrieval and the contexts and prompts built from it.

A scan of the documents keeps, in each task, the k best documents of every question; only those leave the task. Documents stay
where they are; questions travel to the tasks, a block of bounded size at a time. No row per (question, document) pair is formed.
Hits are written before their texts are looked up: Spark then knows how few they are, and sends the hits to the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.functions.text import prompt_text, usable_text
from alertlake.functions.vectors import cosine_distance, euclidean_distance
from alertlake.operators.sizing import spread_small
from alertlake.operators.text_search import entries, in_how_many, shards_of, split_words, weigh
from alertlake.workspace import store

QUESTIONS_AT_ONCE = 8192
DISTANCE_DIGITS = 9
#: Distances that a task holds at once.
CELLS_AT_ONCE = 1_000_000
COLLECTIONS = ("transactions", "summaries")
#: Texts go into a retrieved context up to this many characters; None keeps them whole.
MAX_CHARS = 2000
HIT_SCHEMA = "query_id string, collection string, id string, distance double"

# Wording of contexts.
NOTHING_FOUND = "No specific data found for this query."
NO_RESULTS = "No relevant information found."
CONTEXT_HEADER = "### RETRIEVED CONTEXT:\n\n"
HIDDEN_METADATA = "id"


@dataclass(frozen=True)
class Questions:
    """Question vectors and filters as arrays, for use inside a task."""

    ids: list[str]
    vectors: np.ndarray
    locations: list[str | None]
    starts: np.ndarray
    ends: np.ndarray


def _questions(rows: pd.DataFrame) -> Questions:
    def days(name: str, empty: str) -> np.ndarray:
        if name not in rows:
            return np.full(len(rows), np.datetime64(empty))
        return np.array([np.datetime64(empty) if pd.isna(v) else np.datetime64(v, "D") for v in rows[name]], dtype="datetime64[D]")

    places = [None if pd.isna(v) else v for v in rows["location"]] if "location" in rows else [None] * len(rows)
    vectors = np.array([np.asarray(v, dtype=np.float64) for v in rows["embedding"]], dtype=np.float64)
    return Questions([str(v) for v in rows["query_id"]], vectors, places,
                     days("start_date", "0001-01-01"), days("end_date", "9999-12-31"))


def _distances(documents: np.ndarray, questions: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.sqrt((documents * documents).sum(axis=1))[:, None] * np.sqrt((questions * questions).sum(axis=1))[None, :]
        found = documents @ questions.T
        known = norms > 0
        np.divide(found, norms, out=found, where=known)
        found[~known] = 0.0
        np.subtract(1.0, found, out=found)
        np.round(found, DISTANCE_DIGITS, out=found)
        found += 0.0
        return found
    squares = (documents * documents).sum(axis=1)[:, None] + (questions * questions).sum(axis=1)[None, :]
    products = documents @ questions.T
    products *= 2.0
    squares -= products
    np.sqrt(np.maximum(squares, 0.0, out=squares), out=squares)
    return np.round(squares, DISTANCE_DIGITS, out=squares)


class _Best:
    """The k nearest documents per question seen so far; equal distances go by id."""

    def __init__(self, questions: Questions, k: int, metric: str):
        self.questions, self.k, self.metric = questions, k, metric
        self.found: dict[int, list[tuple[float, str]]] = {}
        self.limits = np.full(len(questions.ids), np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray | None, days: np.ndarray | None) -> None:
        step = max(1, CELLS_AT_ONCE // max(1, len(self.questions.ids)))
        for start in range(0, len(ids), step):
            part = slice(start, start + step)
            distances = _distances(vectors[part], self.questions.vectors, self.metric)
            allowed = _allowed(self.questions, None if places is None else places[part], None if days is None else days[part])
            if allowed is not None:
                distances[~allowed] = np.inf
            limits = self.limits
            if len(distances) >= self.k:
                limits = np.minimum(limits, np.partition(distances, self.k - 1, axis=0)[self.k - 1])
            rows, columns = np.nonzero((distances <= limits[None, :]) & np.isfinite(distances))
            for q in np.unique(columns):
                hits = rows[columns == q]
                merged = self.found.get(q, []) + [(float(distances[r, q]), ids[start + r]) for r in hits]
                merged.sort()
                self.found[q] = merged[: self.k]
                if len(self.found[q]) == self.k:
                    self.limits[q] = self.found[q][-1][0]

    def rows(self, collection: str) -> list[tuple[str, str, str, float]]:
        return [(self.questions.ids[q], collection, i, d) for q, hits in self.found.items() for d, i in hits]


def _allowed(questions: Questions, places, days) -> np.ndarray | None:
    """Which (document, question) cells pass the questions' filters."""
    allowed = None
    if places is not None and any(p is not None for p in questions.locations):
        codes = {p: i for i, p in enumerate(dict.fromkeys(p for p in questions.locations if p is not None))}
        wanted = np.array([-1 if p is None else codes[p] for p in questions.locations])
        have = np.array([codes.get(p, -2) for p in places])
        allowed = (wanted[None, :] == -1) | (have[:, None] == wanted[None, :])
    if (questions.starts > np.datetime64("0001-01-01")).any() or (questions.ends < np.datetime64("9999-12-31")).any():
        inside = (days[:, None] >= questions.starts[None, :]) & (days[:, None] <= questions.ends[None, :])
        allowed = inside if allowed is None else allowed & inside
    return allowed


def _consume(best: dict[str, list[_Best]], make: Callable[[], list[_Best]], batch: pa.RecordBatch, dimensions: int) -> None:
    names = batch.schema.names
    vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    ids = np.array(batch.column("id").to_pylist(), dtype=object)
    collections = np.array(batch.column("collection").to_pylist(), dtype=object)
    places = np.array(batch.column("location").to_pylist(), dtype=object) if "location" in names else None
    days = batch.column("date").to_numpy(zero_copy_only=False).astype("datetime64[D]") if "date" in names else None
    for collection in pd.unique(collections):
        mine = collections == collection
        if collection not in best:
            best[collection] = make()
        for part in best[collection]:
            part.add(ids[mine], vectors[mine], None if places is None else places[mine], None if days is None else days[mine])


def _record(rows: list[tuple[str, str, str, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()),
         pa.array(columns[3], pa.float64())], names=["query_id", "collection", "id", "distance"])


def nearest(queries: DataFrame, documents: DataFrame, k: int = 5, metric: str = "cosine", at_once: int = QUESTIONS_AT_ONCE) -> DataFrame:
    """The k nearest documents per question and collection, with ``rank`` from 1.

    ``queries``: query_id, embedding and optionally location, start_date, end_date, which filter the documents before ranking.
    ``documents``: id, embedding and optionally collection, location, date. A scan of the documents answers ``QUESTIONS_AT_ONCE`` questions
    or ``at_once``, whichever are more, and compares them with a batch ``at_once`` at a time. A vector whose length differs from the
    questions' is reported as an error.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric must be cosine or l2")
    if "location" in queries.columns and "location" not in documents.columns:
        raise ValueError("questions ask for a location but documents have none")
    if {"start_date", "end_date"} & set(queries.columns) and "date" not in documents.columns:
        raise ValueError("questions ask for a period but documents have no date")
    filters = [c for c in ("location",) if c in queries.columns and c in documents.columns]
    dated = ("start_date" in queries.columns or "end_date" in queries.columns) and "date" in documents.columns
    wanted = ["query_id", "embedding", *filters, *[c for c in ("start_date", "end_date") if dated and c in queries.columns]]
    asked = queries.where(F.col("embedding").isNotNull()).select(
        F.col("query_id").cast("string").alias("query_id"),
        *[F.col(c).cast("date").alias(c) if c.endswith("_date") else F.col(c) for c in wanted[1:]])
    collection = F.col("collection") if "collection" in documents.columns else F.lit(COLLECTIONS[0])
    scanned = documents.where(F.col("embedding").isNotNull()).select(
        F.col("id").cast("string").alias("id"), collection.alias("collection"), F.col("embedding"),
        *[F.col(c) for c in filters], *([F.col("date").cast("date").alias("date")] if dated else []))

    total, shortest, longest = asked.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if not total:
        hits = documents.sparkSession.createDataFrame([], HIT_SCHEMA)
    elif shortest != longest:
        raise ValueError(f"questions have from {shortest} to {longest} dimensions")
    else:
        blocks = math.ceil(total / max(at_once, QUESTIONS_AT_ONCE))
        number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        hits = None
        for block in range(blocks):
            part = _scan((asked.where(number == block) if blocks > 1 else asked).toPandas(), scanned, k, metric, filters, at_once)
            hits = part if hits is None else hits.unionByName(part)
    return _ranked(hits, k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "collection").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(local: pd.DataFrame, scanned: DataFrame, k: int, metric: str, filters: list[str], at_once: int) -> DataFrame:
    if local.empty:
        return scanned.sparkSession.createDataFrame([], HIT_SCHEMA)
    questions = _questions(local)
    if "location" in filters and all(p is not None for p in questions.locations):
        scanned = scanned.where(F.col("location").isin(sorted(set(questions.locations))))
    dimensions = questions.vectors.shape[1]
    # Plain values: a broadcast of the class itself would need this package on the executors.
    shared = scanned.sparkSession.sparkContext.broadcast(asdict(questions))

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Questions(**{name: values[at : at + at_once] for name, values in shared.value.items()})
                 for at in range(0, len(shared.value["ids"]), at_once)]
        best: dict[str, list[_Best]] = {}
        for batch in batches:
            if batch.num_rows:
                _consume(best, lambda: [_Best(asked, k, metric) for asked in parts], batch, dimensions)
        yield _record([row for name, of in best.items() for b in of for row in b.rows(name)])

    return _of_length(scanned, dimensions).mapInArrow(best_of_partition, HIT_SCHEMA)


def _of_length(documents: DataFrame, dimensions: int) -> DataFrame:
    """A vector of another length is an error of the data; it is reported, not passed over."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions in document "), F.col("id").cast("string"))).cast("array<float>")
    return documents.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(wrong))


def nearest_hashed(queries: DataFrame, documents: DataFrame, dimensions: int, k: int = 5, metric: str = "cosine", length: float = 0.5,
                   tables: int = 6, seed: int = 11) -> DataFrame:
    """Like ``nearest`` without filters, but approximate: only documents that share a projection bucket with a question are compared.

    Buckets meet in an equi-join, whose large buckets adaptive execution splits; a pair that meets in several tables is compared
    once. What is joined are ids; vectors are fetched for distinct pairs only.
    """
    collection = F.col("collection") if "collection" in documents.columns else F.lit(COLLECTIONS[0])
    asked = _of_length(queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("string").alias("id"), "embedding"), dimensions)
    known = _of_length(documents.where(F.col("embedding").isNotNull()).select(
        F.col("id").cast("string").alias("id"), collection.alias("collection"), "embedding"), dimensions)
    settings = (dimensions, length, tables, seed)
    of_questions = hashed(asked, *settings).select(F.col("id").alias("query_id"), F.explode("buckets").alias("bucket"))
    of_documents = hashed(known, *settings).select("id", "collection", F.explode("buckets").alias("bucket"))
    pairs = of_documents.join(of_questions, "bucket").select("query_id", "collection", "id").distinct()
    both = pairs.join(known, ["collection", "id"]).join(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    measure = cosine_distance if metric == "cosine" else euclidean_distance
    distance = F.round(measure(F.col("embedding"), F.col("_q")), DISTANCE_DIGITS)
    return _ranked(both.select("query_id", "collection", "id", distance.alias("distance")), k)


def hashed(df: DataFrame, dimensions: int, length: float = 0.5, tables: int = 6, seed: int = 11) -> DataFrame:
    """Add ``buckets``: the vector's bucket in each of several random projections, as numbers unique across tables."""
    model_input = df.withColumn("_v", array_to_vector("embedding"))
    lsh = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=length, numHashTables=tables, seed=seed)
    model = lsh.fit(model_input.limit(1))
    keyed = model.transform(model_input)
    values = F.array(*[
        (F.lit(t).cast("bigint") * (1 << 40) + vector_to_array(F.col("_h")[t])[0].cast("bigint")) for t in range(tables)])
    return keyed.withColumn("buckets", values).drop("_v", "_h")


def embed_with(df: DataFrame, embed: Callable[[list[str]], list], text: str = "text", name: str = "embedding") -> DataFrame:
    """Vectors from any function of a list of texts, called once per Arrow batch in the tasks."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embed(frame[text].fillna("").tolist()) if len(frame) else []
            yield frame.assign(**{name: [np.asarray(v, dtype=np.float32) for v in vectors]})

    return spread_small(df.drop(name)).mapInPandas(run, f"{schema}, `{name}` array<float>")


def term_weights(df: DataFrame, key: str, text: str = "text", places: int | None = None) -> DataFrame:
    """(key, word, weight) of every distinct blank-separated word of a text: term count times ln((n + 1) / (documents + 1)), each
    text's weights scaled to length 1. With ``places``, words are hashed to so many places and ``place`` stands for the word; the
    rows are then the filled places of a sparse vector.

    Rows of one key are one text; a NULL key's words count as those of a text, without rows of their own. Texts move once, to the other rows
    of their key, and become shards, which ask once for each of their words in how many texts it stands: no row per text and word is shuffled.
    """
    name = "word" if places is None else "place"
    texts = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).repartition("_key").sortWithinPartitions("_key")
    words = split_words("_text")
    if places is not None:
        known = F.filter(words, lambda w: w != "")
        words = F.transform(known, lambda w: F.pmod(F.xxhash64(w), F.lit(places)).cast("string"))
    shards = store(shards_of(texts, "_key", id_type=df.schema[key].dataType.simpleString(), grouped=True, words=words), "term-shards", True)
    found = entries(weigh(shards, in_how_many(shards), df.count()), key, name).where(F.col(key).isNotNull())
    return found if places is None else found.withColumn(name, F.col(name).cast("int"))


# ---- contexts -------------------------------------------------------------------------------------------------------

def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach text and metadata to hits. The hits are written first, so the join knows their size and leaves the texts in place."""
    collection = F.col("collection") if "collection" in documents.columns else F.lit(COLLECTIONS[0])
    body = documents.select(F.col("id").cast("string").alias("id"), collection.alias("collection"), "text",
                            *[c for c in ("metadata",) if c in documents.columns])
    return store(store(hits, "hits").join(body, ["id", "collection"]), "hit-texts")


def item_context(hits: DataFrame, max_items: int = 5) -> DataFrame:
    """Per question and collection: numbered items with their metadata lines and text."""
    lines = F.lit("")
    if "metadata" in hits.columns:
        keys = [f.name for f in hits.schema["metadata"].dataType.fields if f.name != HIDDEN_METADATA]
        lines = F.concat(F.lit("--- Item "), F.col("rank").cast("string"), F.lit(" ---\n"), *[
            F.coalesce(F.concat(F.lit(f"{key}: "), F.col("metadata").getField(key).cast("string"), F.lit("\n")), F.lit("")) for key in keys])
    item = F.concat(lines, F.coalesce("text", F.lit("")), F.lit("\n\n"))
    return (
        hits.where(F.col("rank") <= max_items).select("query_id", "collection", "rank", item.alias("item"))
        .groupBy("query_id", "collection")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]), "").alias("context"))
    )


def retrieved_texts(queries: DataFrame, hits: DataFrame, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Per question the usable texts of its hits, transactions first; a fixed sentence when there is none."""
    side = F.when(F.col("collection") == COLLECTIONS[0], 0).otherwise(1)
    texts = (
        hits.withColumn("text", usable_text(F.col("text"), max_chars)).where(F.col("text").isNotNull())
        .select("query_id", F.struct(side.alias("side"), "rank", "text").alias("s"))
        .groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]).alias("texts"))
    )
    asked = queries.withColumn("query_id", F.col("query_id").cast("string"))
    return asked.join(texts, "query_id", "left").withColumn("texts", F.coalesce("texts", F.array(F.lit(NOTHING_FOUND))))


def _numbered(texts: Column, label: str, between: str) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit(f"{label} "), (i + 1).cast("string"), F.lit(":\n"), t)), between)


def query_context(texts: Column) -> Column:
    return F.concat(F.lit(CONTEXT_HEADER), _numbered(texts, "Document", "\n\n"), F.lit("\n\n"))


def augmented_query(query: Column, texts: Column, additional: Column | None = None) -> Column:
    more = F.lit("") if additional is None else F.coalesce(
        F.concat(F.lit("Additional Context:\n"), F.nullif(additional, F.lit("")), F.lit("\n\n")), F.lit(""))
    return F.concat(F.lit("Query: "), query, F.lit("\n\nRetrieved Context:\n"), _numbered(texts, "Context", "\n\n"), F.lit("\n\n"), more)


def _sides(requests: DataFrame, contexts: DataFrame, title: Column) -> DataFrame:
    """Both collections' contexts of each request under headings."""
    wide = contexts.groupBy("query_id").agg(
        F.max(F.when(F.col("collection") == COLLECTIONS[0], F.col("context"))).alias("_t"),
        F.max(F.when(F.col("collection") == COLLECTIONS[1], F.col("context"))).alias("_s"))
    asked = requests.withColumn("query_id", F.col("query_id").cast("string"))
    return asked.join(wide, "query_id", "left").withColumn("context", F.concat(
        F.lit("TRANSACTION DETAILS "), title, F.lit(":\n"), F.coalesce("_t", F.lit("")), F.lit("\n\n"),
        F.lit("BRANCH SUMMARIES "), title, F.lit(":\n"), F.coalesce("_s", F.lit("")))).drop("_t", "_s")


def retrieve(requests: DataFrame, documents: DataFrame, k: int = 5, metric: str = "cosine", max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Requests (query_id, embedding) with ``texts`` from both collections."""
    plain = requests.drop("location", "start_date", "end_date")
    return retrieved_texts(requests, with_documents(nearest(plain, documents, k, metric), documents), max_chars)


def _branch_title() -> Column:
    return F.concat(F.lit("FOR "), F.col("branch"))


def _period_title() -> Column:
    return F.concat(F.lit("from "), F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string"),
                    F.coalesce(F.concat(F.lit(" for "), F.col("branch")), F.lit("")))


def branch_context(requests: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """Requests (query_id, embedding, branch) with the context of their branch."""
    asked = requests.select("query_id", "embedding", F.col("branch").alias("location"))
    return _sides(requests, item_context(with_documents(nearest(asked, documents, k), documents), k), _branch_title())


def date_range_context(requests: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """Requests (query_id, embedding, start_date, end_date, branch or NULL) with the context of their period."""
    asked = requests.select("query_id", "embedding", F.col("branch").alias("location"), "start_date", "end_date")
    return _sides(requests, item_context(with_documents(nearest(asked, documents, k), documents), k), _period_title())


def _tagged(tag: str) -> Column:
    return F.concat(F.lit(f"{tag}:"), F.col("query_id").cast("string"))


def _compared(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts of the questions tagged a and b, side by side."""
    parts = contexts.select(F.substring("query_id", 1, 1).alias("side"), F.expr("substring(query_id, 3)").alias("query_id"), "context")
    wide = parts.groupBy("query_id").pivot("side", ["a", "b"]).agg(F.first("context"))
    asked_for = requests.withColumn("query_id", F.col("query_id").cast("string"))
    return asked_for.join(wide, "query_id", "left").withColumns({
        "branch_a_context": F.coalesce("a", F.lit("")), "branch_b_context": F.coalesce("b", F.lit(""))}).drop("a", "b")


def comparison_context(requests: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """Requests (query_id, embedding, branch, compare_with) with the summaries of both branches side by side."""
    sides = F.explode(F.array(F.struct(_tagged("a").alias("tagged"), F.col("branch").alias("location")),
                              F.struct(_tagged("b").alias("tagged"), F.col("compare_with").alias("location"))))
    asked = requests.select("embedding", sides.alias("s")).select(F.col("s.tagged").alias("query_id"), "embedding", "s.location")
    summaries = documents.where(F.col("collection") == COLLECTIONS[1])
    return _compared(requests, item_context(with_documents(nearest(asked, summaries, k), summaries), k))


def prompts(requests: DataFrame, documents: DataFrame, k: int = 5, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Prompt per request, by its ``alert_type``: general, branch, fraud, comparison or trend.

    ``requests``: query_id, query, alert_type, branch, compare_with, start_date, end_date, timeframe, embedding. All kinds are
    answered by one scan of the vectors and one of the texts: a request becomes one or two tagged questions with its own filters.
    """
    kind = F.col("alert_type")
    none, no_day = F.lit(None).cast("string"), F.lit(None).cast("date")

    def question(tag: str, place: Column, start: Column = no_day, end: Column = no_day) -> Column:
        return F.struct(_tagged(tag).alias("query_id"), place.alias("location"), start.alias("start_date"), end.alias("end_date"))

    start, end = F.col("start_date").cast("date"), F.col("end_date").cast("date")
    asked = requests.select("embedding", F.explode(
        F.when(kind == "branch", F.array(question("p", F.col("branch"))))
        .when(kind == "comparison", F.array(question("a", F.col("branch")), question("b", F.col("compare_with"))))
        .when(kind == "trend", F.array(question("t", F.col("branch"), start, end)))
        .when(kind.isin("general", "fraud"), F.array(question("g", none)))).alias("s")).select("s.*", "embedding")
    hits = with_documents(nearest(asked, documents, k), documents)
    tag, bare = F.substring("query_id", 1, 1), F.expr("substring(query_id, 3)").alias("query_id")
    others = [c for c in hits.columns if c != "query_id"]

    def hits_of(*tags: str) -> DataFrame:
        return hits.where(tag.isin(*tags))

    def of(*kinds: str) -> DataFrame:
        return requests.where(kind.isin(*kinds))

    period = F.coalesce("timeframe", F.lit("recent"))
    open_ended = retrieved_texts(of("general", "fraud"), hits_of("g").select(bare, *others), max_chars).withColumn(
        "context", query_context(F.col("texts")))
    general = prompt_text("general", {"query": F.col("query"), "context": F.col("context")})
    fraud = prompt_text("fraud", {"context": F.col("context")})
    branch = _sides(of("branch"), item_context(hits_of("p").select(bare, *others), k), _branch_title())
    trend = _sides(of("trend"), item_context(hits_of("t").select(bare, *others), k), _period_title())
    compared = _compared(of("comparison"), item_context(hits_of("a", "b").where(F.col("collection") == COLLECTIONS[1]), k))
    span = F.concat(F.col("start_date").cast("string"), F.lit(" to "), F.col("end_date").cast("string"),
                    F.coalesce(F.concat(F.lit(" for "), F.col("branch")), F.lit("")))
    out = [
        open_ended.withColumn("prompt", F.when(kind == "general", general).otherwise(fraud)),
        branch.withColumn("prompt", prompt_text("branch", {
            "branch": F.col("branch"), "time_period": period, "context": F.col("context")})),
        compared.withColumn("prompt", prompt_text("comparison", {
            "time_period": period, "branch_a_context": F.col("branch_a_context"), "branch_b_context": F.col("branch_b_context")})),
        trend.withColumn("prompt", prompt_text("trend", {"time_period": span, "context": F.col("context")})),
    ]
    keep = [c for c in requests.columns if c != "embedding"]
    united = out[0].select(*keep, "prompt")
    for frame in out[1:]:
        united = united.unionByName(frame.select(*keep, "prompt"))
    return united
