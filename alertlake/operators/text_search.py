"""Text questions: the best documents by dot product of term weights, from an inverted index that skips blocks.

Documents and questions go through the weights of ``retrieval.term_weights``: the count of a word times ln((n + 1) / (d + 1)), each text
scaled to length 1. Texts become shards of some thousand documents; a shard asks once for each of its words in how many documents it stands,
so a common word travels once per shard and not once per document, and every weight is then worked out inside the shard.

A few questions are searched one by one. In a shard a word's posting list is sorted by weight and cut into blocks, each with its greatest weight. A
question's bound on all documents it hasn't met is the sum, over its words, of its weight times the greatest weight of the word's next block. It reads
the most promising block next, scores that block's documents in full, and stops when the bound can't reach its k-th hit.

Many questions are whole texts often, whose bound falls late, so their weights are multiplied with those of some documents at a time: words that many of
the questions hold as a dense matrix, all others entry by entry. Either way every document is judged and the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertlake.workspace import store

SHARD_DOCUMENTS, SHARD_WORDS = 8192, 2_000_000
#: Words of texts that are counted at once.
COUNTED_AT_ONCE = 1_000_000
BLOCK = 64
#: Questions, and distinct words of theirs, that go to the tasks at once (one question always goes).
QUESTIONS_AT_ONCE, WORDS_AT_ONCE = 1024, 1_000_000
#: Up to so many questions are searched one by one; of more, so many blocks share a scan of the index.
FEW_QUESTIONS, BLOCKS_AT_ONCE = 4, 4
#: Words that one in so many questions holds are columns of a dense matrix, the most common ones up to a number.
SHARED_BY, COLUMNS = 16, 1024
#: Documents, and products of single entries, that a task holds at once.
DOCUMENTS_AT_ONCE, PRODUCTS_AT_ONCE = 512, 1_000_000
SCORE_DIGITS = 9
SLACK = 1e-9
ENTRIES_AT_ONCE = 1 << 16
SHARDS = "shard long, ids array<{id}>, words array<string>, spread array<long>, doc binary, word binary, n binary"
INDEX = "shard long, ids array<string>, words array<string>, doc binary, word binary, weight binary"
HITS = "query_id string, id string, score double"


def split_words(text: str) -> Column:
    return F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\s+")


def packed(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Whole numbers in few bytes: all their lowest bytes, then all their second ones and so on, compressed."""
    planes = np.ascontiguousarray(numbers, kind).view(np.uint8).reshape(len(numbers), -1).T if len(numbers) else np.zeros(0, np.uint8)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: str = "<i4") -> np.ndarray:
    number, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not number:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], number * size, "zstd", asbytes=True), np.uint8).reshape(size, number)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def places_of(doc: bytes, word: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(documents, words) of the entries of a shard, by document and word."""
    sizes = unpacked(doc)
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.cumsum(unpacked(word), dtype=np.int32)


def spread_in(weight: bytes) -> np.ndarray:
    """In how many documents of all shards each word of an index's row stands."""
    return unpacked(weight[16 + int.from_bytes(weight[8:16], "little") :], "<i8")


def opened(doc: bytes, word: bytes, weight: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, words, weights) of the entries of an index's row, by document and word."""
    documents, words = places_of(doc, word)
    total, size = (int.from_bytes(weight[at : at + 8], "little") for at in (0, 8))
    weights = unpacked(weight[16 : 16 + size]) * np.log((total + 1) / (spread_in(weight) + 1.0))[words]
    length = np.sqrt(np.bincount(documents, weights=weights * weights))[documents]
    return documents, words, np.divide(weights, length, out=np.zeros_like(weights), where=length > 0)


def shards_of(texts: DataFrame, key: str, text: str = "text", shard_documents: int = SHARD_DOCUMENTS, shard_words: int = SHARD_WORDS,
              id_type: str = "string", grouped: bool = False, words: Column | None = None) -> DataFrame:
    """Shards: ids, distinct words, in how many documents of the shard each stands, and (document, word, count) as packed numbers.

    With ``grouped``, rows that follow each other under one id are one document. ``words`` stands for the words of the text, blanks at its ends included.
    """
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, place, parts, size, kind = [], {}, [], 0, pa.string()

        def row() -> pa.RecordBatch:
            doc, word, n = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*parts) if parts else ((), (), ())))
            entry = doc * max(1, len(place)) + word
            order = np.argsort(entry, kind="stable")
            entry = entry[order]
            starts = np.flatnonzero(np.diff(entry, prepend=-1))
            n = np.add.reduceat(n[order], starts) if len(starts) else n  # a document's rows may have come in several parts
            doc, word = np.divmod(entry[starts], max(1, len(place)))
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([list(place)], pa.list_(pa.string())),
                pa.array([np.bincount(word, minlength=len(place))], pa.list_(pa.int64())), pa.array([packed(np.bincount(doc, minlength=len(ids)))], pa.binary()),
                pa.array([packed(np.diff(word, prepend=0))], pa.binary()), pa.array([packed(n)], pa.binary())],
                names=["shard", "ids", "words", "spread", "doc", "word", "n"])

        for batch in batches:
            kind = batch.schema.field(0).type
            names, lists = batch.column(0).to_pylist(), batch.column(1)
            ends = np.cumsum(np.concatenate([[0], lists.value_lengths().fill_null(0).to_numpy()]))
            at = 0
            while at < len(names):  # some words at a time
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + COUNTED_AT_ONCE, "right")) - 1)
                found = lists.slice(at, to - at).flatten().dictionary_encode()
                own, empty = found.dictionary, found.dictionary.index("").as_py()
                entry = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])) * max(1, len(own)) + found.indices.to_numpy()
                entry, n = np.unique(entry, return_counts=True)
                doc, code = np.divmod(entry, max(1, len(own)))
                if empty >= 0:
                    doc, code, n = doc[code != empty], code[code != empty], n[code != empty]
                first = np.searchsorted(doc, np.arange(to - at + 1))
                numbers, begun = [], 0

                def take(begin: int, end: int) -> None:
                    """The counted rows from ``begin`` to ``end`` go to the shard that is open."""
                    if first[begin] == first[end]:
                        return
                    span = slice(first[begin], first[end])
                    used, which = np.unique(code[span], return_inverse=True)
                    numbered = np.array([place.setdefault(w, len(place)) for w in own.take(pa.array(used)).to_pylist()], np.int64)
                    parts.append((np.array(numbers, np.int64)[doc[span] - begin], numbered[which], n[span]))

                for i in range(to - at):
                    id_ = names[at + i]
                    if not (grouped and ids and ids[-1] == id_):
                        if len(ids) >= shard_documents or size >= shard_words:
                            take(begun, i)
                            yield row()
                            number, ids, place, parts, size, numbers, begun = number + 1, [], {}, [], 0, [], i
                        ids.append(id_)
                    numbers.append(len(ids) - 1)
                    size += first[i + 1] - first[i]
                take(begun, to - at)
                at = to
        if ids:
            yield row()

    words = split_words(text) if words is None else words
    return texts.select(F.col(key).cast(id_type).alias("id"), words.alias("w")).mapInArrow(gather, SHARDS.format(id=id_type))


def weigh(shards: DataFrame, spread: DataFrame, total: int) -> DataFrame:
    """The index of shards whose words stand in ``spread`` = (word, d). A word that isn't there counts with d = 0.

    A shard meets its answers as a cogroup, so a task holds those of one shard, and not lists of all shards it sees. ``weight`` has what the weights
    are worked out from by ``opened``: a number per entry and one per word take a fraction of the room of a weight per entry.
    """
    answers = asked_words(shards).join(spread, "word").select("asking", "place", "d")

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        made = []
        for i in range(rows.num_rows):
            d = np.zeros(len(rows.column("words")[i]), np.int64)
            d[answers.column("place").to_numpy()] = answers.column("d").to_numpy()
            n = rows.column("n")[i].as_py()
            made.append(total.to_bytes(8, "little") + len(n).to_bytes(8, "little") + n + packed(d, "<i8"))
        return pa.table([*[rows.column(c) for c in ("shard", "ids", "words", "doc", "word")], pa.array(made, pa.binary())],
                        names=["shard", "ids", "words", "doc", "word", "weight"])

    rows = shards.select("shard", "ids", "words", "doc", "word", "n")
    ids = rows.schema["ids"].dataType.simpleString()
    return rows.groupBy("shard").cogroup(answers.groupBy("asking")).applyInArrow(run, INDEX.replace("ids array<string>", f"ids {ids}"))


def in_how_many(shards: DataFrame) -> DataFrame:
    """(word, d): in how many documents of all shards a word stands. Written, since every shard asks it."""
    pairs = shards.select(F.explode(F.arrays_zip("words", "spread")).alias("w"))
    return store(pairs.groupBy(F.col("w.words").alias("word")).agg(F.sum("w.spread").alias("d")), "text-spread", tidy=True)


def asked_words(shards: DataFrame) -> DataFrame:
    """(asking, place, word): every shard's distinct words."""
    return shards.select(F.col("shard").alias("asking"), F.posexplode("words").alias("place", "word"))


def text_index(documents: DataFrame, key: str = "id", text: str = "text", **sizes) -> tuple[DataFrame, DataFrame, int]:
    """(index, spread, number of documents): the written index, and in how many documents every word stands. Repeated ids are documents apart."""
    shards = store(shards_of(documents, key, text, **sizes), "text-shards", True, True)
    spread = in_how_many(shards)
    total = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    return store(weigh(shards, spread, total), "text-index", True, True), spread, total


def entries(index: DataFrame, key: str, name: str, at_once: int = ENTRIES_AT_ONCE) -> DataFrame:
    """(key, name, weight): the entries of an index as rows; ``name`` is the column of the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words = batch.column(0)[i].values, batch.column(1)[i].values
                doc, word, weight = opened(*[batch.column(c)[i].as_py() for c in (2, 3, 4)])
                for at in range(0, len(doc), at_once):
                    part = slice(at, at + at_once)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc[part])), words.take(pa.array(word[part])), pa.array(weight[part])], names=[key, name, "weight"])

    schema = T.StructType([T.StructField(key, index.schema["ids"].dataType.elementType), T.StructField(name, T.StringType()), T.StructField("weight", T.DoubleType())])
    return index.select("ids", "words", "doc", "word", "weight").mapInArrow(run, schema)


class Shard:
    """A shard of the index, opened for questions."""

    def __init__(self, ids: list[str], words: list[str], doc: bytes, word: bytes, weight: bytes, block: int):
        self.ids, self.place, self.block = ids, {w: i for i, w in enumerate(words)}, block
        self.doc, self.word, self.weight = np.frombuffer(doc, np.int32), np.frombuffer(word, np.int32), np.frombuffer(weight, np.float64)
        self.first = np.searchsorted(self.word, np.arange(len(words) + 1))
        by_doc = np.argsort(self.doc, kind="stable")
        self.own_word, self.own_weight = self.word[by_doc], self.weight[by_doc]
        self.start = np.searchsorted(self.doc[by_doc], np.arange(len(ids) + 1))

    def scores(self, documents: np.ndarray, question: np.ndarray) -> np.ndarray:
        sizes = self.start[documents + 1] - self.start[documents]
        at = np.repeat(self.start[documents] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.round(np.bincount(np.repeat(np.arange(len(documents)), sizes), weights=self.own_weight[at] * question[self.own_word[at]],
                                    minlength=len(documents)), SCORE_DIGITS)

    def search(self, words: list[str], weights: list[float], best: list, k: int) -> tuple[int, int]:
        """Put documents into a heap of the k best. Returns (blocks of the question's lists, blocks read)."""
        known = [(self.place[w], x) for w, x in zip(words, weights) if x > 0 and w in self.place]
        lists = np.array([p for p, _ in known], np.int64)
        if not len(lists):
            return 0, 0
        question = np.zeros(len(self.place))
        question[lists] = weights = np.array([x for _, x in known])
        at, ends = self.first[lists].copy(), self.first[lists + 1]
        tops = weights * self.weight[at]
        seen, read = np.zeros(len(self.ids), bool), 0
        while True:
            bound = tops.sum()
            if bound <= 0 or len(best) == k and bound + 1e-9 < best[0][0]:
                return int((-(-(ends - self.first[lists]) // self.block)).sum()), read
            i = int(np.argmax(tops))
            stop = min(at[i] + self.block, ends[i])
            documents = self.doc[at[i] : stop]
            documents = documents[~seen[documents]]
            seen[documents] = True
            read += 1
            if len(documents):
                found = self.scores(documents, question)
                for j in np.flatnonzero(found >= (best[0][0] if len(best) == k else np.nextafter(0, 1))):
                    entry = (float(found[j]), _After(self.ids[documents[j]]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            at[i] = stop
            tops[i] = weights[i] * self.weight[stop] if stop < ends[i] else 0.0


class _After:
    """Ids in the order in which they give way to others of one score: later ones first."""

    __slots__ = ("id",)

    def __init__(self, id_: str):
        self.id = id_

    def __lt__(self, other) -> bool:
        return self.id > other.id

    def __eq__(self, other) -> bool:
        return self.id == other.id


def nearest_texts(queries: DataFrame, documents: DataFrame, k: int = 5, block: int = BLOCK, at_once: int = QUESTIONS_AT_ONCE, **sizes) -> DataFrame:
    """The k documents (id, text) most similar to each question (query_id, text): (query_id, id, rank, score).

    Scores are rounded to nine decimals, equal ones go by id. A document that shares no word of any weight with the question has no row, so a question
    without words has none. NULL texts have no words. Questions come to the driver in blocks of bounded size, and each block is one
    scan of the index.
    """
    index, spread, total = text_index(documents, **sizes)
    return search_texts(queries, index, spread, total, k, block, at_once, **sizes)


def search_texts(queries: DataFrame, index: DataFrame, spread: DataFrame, total: int, k: int = 5, block: int = BLOCK,
                 at_once: int = QUESTIONS_AT_ONCE, **sizes) -> DataFrame:
    """``nearest_texts`` with an index that is there already. Questions are weighed as documents are, by the documents' statistics."""
    spark = queries.sparkSession
    sizes = {"shard_documents": at_once, "shard_words": WORDS_AT_ONCE, **sizes}
    asked = store(weigh(store(shards_of(queries, "query_id", **sizes), "question-shards", True, True), spread, total), "questions", True, True)
    hits = spark.createDataFrame([], HITS)
    few, many = [], []
    for ids, words, doc, word, weight in _blocks(asked.toLocalIterator(), at_once):
        if len(ids) > FEW_QUESTIONS:
            many.append(Asked(ids, words, doc, word, weight))
        else:
            few += [(id_, [words[w] for w in word[doc == i]], weight[doc == i].tolist()) for i, id_ in enumerate(ids)]
        if len(many) == BLOCKS_AT_ONCE:
            hits, many = hits.unionByName(_scan_many(index, many, k)), []
        if len(few) > FEW_QUESTIONS:
            hits, few = hits.unionByName(_scan(index, few, k, block)), []
    if many:
        hits = hits.unionByName(_scan_many(index, many, k))
    if few:
        hits = hits.unionByName(_scan(index, few, k, block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def _blocks(shards: Iterator, at_once: int) -> Iterator[tuple[list, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, documents, words' numbers, weights): shards of questions, those of few questions together."""
    ids, place, parts, size = [], {}, [], 0

    def block() -> tuple:
        return ids, list(place), *(np.concatenate(c) for c in zip(*parts))

    for row in shards:
        doc, word, weight = opened(row["doc"], row["word"], row["weight"])
        if ids and (len(ids) + len(row["ids"]) > at_once or size + len(doc) > WORDS_AT_ONCE):
            yield block()
            ids, place, parts, size = [], {}, [], 0
        numbered = np.array([place.setdefault(w, len(place)) for w in row["words"]], np.int32)
        parts.append((doc + len(ids), numbered[word], weight))
        ids, size = ids + list(row["ids"]), size + len(doc)
    if ids:
        yield block()


def _hits(rows: list[tuple[str, str, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())],
                                      names=["query_id", "id", "score"])


def _scan(index: DataFrame, questions: list[tuple[str, list[str], list[float]]], k: int, block: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(questions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, *parts = (column[i].as_py() for column in batch.columns)
                doc, word, weight = opened(*parts)
                order = np.lexsort((doc, -weight, word))
                shard = Shard(ids, words, *[x[order].tobytes() for x in (doc, word, weight)], block)
                for heap, (_, words, weights) in zip(best, shared.value):
                    shard.search(words, weights, heap, k)
        yield _hits([(q[0], e[1].id, e[0]) for q, heap in zip(shared.value, best) for e in heap])

    return index.select("ids", "words", "doc", "word", "weight").mapInArrow(run, HITS)


class Asked:
    """Questions as a matrix of words by questions: its entries by word, and the common words' rows in full."""

    def __init__(self, ids: list[str], words: list[str], question: np.ndarray, word: np.ndarray, weight: np.ndarray):
        self.ids, self.words = ids, pa.array(words, pa.string())
        question, word, weight = (x[weight > 0] for x in (question, word, weight))
        order = np.argsort(word, kind="stable")
        self.question, self.weight = question[order].astype(np.int64), weight[order]
        self.number = np.bincount(word, minlength=len(words))
        self.first = np.cumsum(self.number) - self.number
        common = np.argsort(-self.number, kind="stable")[:COLUMNS]
        common = common[self.number[common] * SHARED_BY >= max(1, len(ids))]
        self.column = np.full(len(words), -1, np.int64)
        self.column[common] = np.arange(len(common))
        self.common = np.zeros((len(common), len(ids)))
        column = self.column[word]
        self.common[column[column >= 0], question[column >= 0]] = weight[column >= 0]
        self.number[common] = 0  # what is left is multiplied entry by entry

    def scores(self, doc: np.ndarray, word: np.ndarray, weight: np.ndarray, documents: int) -> np.ndarray:
        """Documents by questions: the products of the documents' entries with the questions'."""
        column = self.column[word]
        dense, known = np.zeros((documents, len(self.common))), column >= 0
        dense[doc[known], column[known]] = weight[known]
        out = dense @ self.common
        rest = np.flatnonzero(self.number[word])
        doc, weight, number, first = doc[rest].astype(np.int64) * len(self.ids), weight[rest], self.number[word[rest]], self.first[word[rest]]
        ends, at = np.cumsum(number), 0
        while at < len(rest):  # some products at a time
            before = ends[at] - number[at]
            to = max(at + 1, int(np.searchsorted(ends, before + PRODUCTS_AT_ONCE, "right")))
            times = number[at:to]
            entry = np.arange(ends[to - 1] - before) + np.repeat(first[at:to] - (ends[at:to] - times - before), times)
            cell = np.repeat(doc[at:to], times) + self.question[entry]
            out += np.bincount(cell, weights=np.repeat(weight[at:to], times) * self.weight[entry], minlength=out.size).reshape(out.shape)
            at = to
        return out


def _scan_many(index: DataFrame, blocks: list[Asked], k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast([vars(asked) for asked in blocks])  # plain values, as in retrieval

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Asked.__new__(Asked) for _ in shared.value]
        for asked, values in zip(blocks, shared.value):
            asked.__dict__.update(values)
        best: list[list[list[tuple[float, str]]]] = [[[] for _ in asked.ids] for asked in blocks]
        limits = [np.zeros(len(asked.ids)) for asked in blocks]  # of each question what a score has to reach
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words = batch.column(0)[i].values, batch.column(1)[i].values
                doc, word, weight = opened(*[batch.column(c)[i].as_py() for c in (2, 3, 4)])
                edges = np.searchsorted(doc, np.arange(0, len(ids) + DOCUMENTS_AT_ONCE, DOCUMENTS_AT_ONCE))
                for asked, held, limit in zip(blocks, best, limits):
                    place = pc.index_in(words, value_set=asked.words).fill_null(-1).to_numpy()
                    for at, (begin, end) in enumerate(zip(edges[:-1], edges[1:])):
                        own = np.flatnonzero(place[word[begin:end]] >= 0) + begin
                        if len(own):
                            part = ids.slice(at * DOCUMENTS_AT_ONCE, DOCUMENTS_AT_ONCE)
                            scores = asked.scores(doc[own] - at * DOCUMENTS_AT_ONCE, place[word[own]], weight[own], len(part))
                            _keep(held, limit, scores, part, k)
        yield _hits([(q, id_, -score) for asked, of in zip(blocks, best) for q, held in zip(asked.ids, of) for score, id_ in held])

    return index.select("ids", "words", "doc", "word", "weight").mapInArrow(run, HITS)


def _keep(best: list[list[tuple[float, str]]], limits: np.ndarray, scores: np.ndarray, ids: pa.Array, k: int) -> None:
    """Put documents into the lists (-score, id) of the k best of every question. Equal scores go by id."""
    near = scores >= np.maximum(limits - SLACK, SLACK / 4)
    if len(scores) > k and near.sum() > k * len(best):
        near &= scores >= np.partition(scores, -k, axis=0)[-k] - SLACK
    questions, documents = np.nonzero(near.T)
    found = np.round(scores[documents, questions], SCORE_DIGITS)
    for q in np.unique(questions).tolist():
        own = slice(*np.searchsorted(questions, (q, q + 1)))
        new = [(-s, id_) for s, id_ in zip(found[own].tolist(), ids.take(pa.array(documents[own])).to_pylist()) if s > 0]
        best[q] = sorted(best[q] + new, key=lambda hit: (hit[0], hit[1] is not None, hit[1] or ""))[:k]
        if len(best[q]) == k:
            limits[q] = -best[q][-1][0]
