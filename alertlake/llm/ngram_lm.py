"""LM scoring with an interpolated trigram model whose trie is dealt over the tasks by context.

Documents are tokenised once, into runs. For each order a run asks about its distinct n-grams, with their counts in the documents
to learn from. The task that owns a share of the contexts adds up the counts, builds that part of the trie (ngram_trie) and answers
every run from it: the quantised discounted share of each n-gram, and what each context leaves to the lower order. The next order's
context is the node of the n-gram found before, its successor the rank among the successors of the shorter context, so numbers stay
small. A node is known by its rank and the first node of its context, which all successors of a context share in an answer. No task ever holds the whole model, and nothing is sent twice for the same n-gram of a run.

    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))        p_n(w | h) = share(h, w) + left(h) p_{n-1}(w | h')

share is (c - discount) / c(h), for trigrams only if counted twice; left is one minus the shares of h, so that probabilities add up
to at most one. Contexts that were never learned leave everything. Trigram contexts are bigrams counted twice.

Defined cases: a null or empty text is its end token alone; without documents to learn from every token has p1 = 1; repeated rows
are learned and scored one by one; the words of a text follow a start symbol that is a context but not a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import bucketed, id_and_text, per_gigabyte, slices, with_id
from alertlake.llm.ngram_trie import UNNAMED, Level, restore
from alertlake.llm.runs import (answers_by_run, free, pack, pack_columns, partitions, planes, squeeze, unpack, unpack_columns, unplanes,
                                unsqueeze)

#: Numbers of words and nodes: the share that owns them above these bits, their rank below. Number 0 is the start of a text.
RANK_BITS = 40
START, UNKNOWN = 0, UNNAMED


@dataclass(frozen=True)
class TrigramMethod:
    discount: float = 0.75
    run_bytes: int = 6 << 20
    share_bytes: int = 32 << 20


def tokenised(docs: DataFrame, learn: Column, method: TrigramMethod, id_col: str, text_col: str) -> DataFrame:
    """(run, docs, tokens, hashes, learned, n_bytes): texts as places in the run's sorted word hashes."""
    def tokenise(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        def row(number, parts, words, sizes, size):
            known = dict.fromkeys(words)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
            order = np.argsort(hashes)
            rank = np.empty(len(known), np.int32)
            rank[order] = np.arange(len(known), dtype=np.int32)
            place = dict(zip(known, rank.tolist()))
            tokens = np.fromiter(map(place.__getitem__, words), np.int32, len(words))
            table = pa.Table.from_batches(parts).drop_columns(["text"]).append_column("n", pa.array(sizes, pa.int64()))
            learned = int(sum(n for n, yes in zip(sizes, table.column("learn").to_pylist()) if yes))
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([pack(table)], pa.binary()),
                                    pa.array([planes(tokens)], pa.binary()), pa.array([squeeze(hashes[order])], pa.binary()),
                                    pa.array([learned], pa.int64()), pa.array([size], pa.int64())],
                                   ["run", "docs", "tokens", "hashes", "learned", "n_bytes"])

        number, parts, words, sizes, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for part, texts in slices(batches):
            parts.append(part)
            for data in texts:
                before = len(words)
                words += data.lower().split() if data else ()
                words.append(b"")  # no word is empty: the end token
                sizes.append(len(words) - before)
                size += len(data or b"") + 8
            if size >= method.run_bytes:
                yield row(number, parts, words, sizes, size)
                number, parts, words, sizes, size = number + 1, [], [], [], 0
        if parts:
            yield row(number, parts, words, sizes, size)

    rows = id_and_text(docs, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("learn")).mapInArrow(
        tokenise, "run long, docs binary, tokens binary, hashes binary, learned long, n_bytes long")
    return bucketed(rows, "lm-runs", "run", partitions(docs))


class Run:
    """A run's tokens with the answers that came back so far."""

    def __init__(self, docs: bytes, tokens: bytes, hashes: bytes):
        import numpy as np

        self.docs = unpack(docs)
        self.words = unplanes(tokens, "<i4")
        self.hashes = unsqueeze(hashes)
        self.sizes = self.docs.column("n").to_numpy()
        self.learn = np.repeat(self.docs.column("learn").to_numpy(zero_copy_only=False), self.sizes)
        self.first = np.zeros(len(self.words), bool)
        if len(self.sizes):
            self.first[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = True

    def word_answers(self, answers) -> None:
        """Count and number of every token's word."""
        import numpy as np

        parts = [unpack_columns(a["found"]) for a in sorted(answers, key=lambda a: a["share"])]
        gather = lambda c: np.concatenate([p[c] for p in parts])
        self.count, self.number = gather("count")[self.words], gather("number")[self.words]

    def bigrams(self):
        """(context, successor) of each token; the context is 2^64-1 where it was never learned."""
        import numpy as np

        context = np.concatenate([[np.uint64(START)], self.number[:-1]]) if len(self.number) else self.number
        context = np.where(self.first, np.uint64(START), context)
        return np.where(context == UNKNOWN, np.uint64(2**64 - 1), context), self.number

    def bigram_answers(self, answers) -> None:
        self.share2, self.left2, self.node2, self.rank2 = self._spread(answers, *self.bigrams(), True)

    def trigrams(self):
        """The context is the node of the bigram before, the successor the rank of the token's own bigram in its context."""
        import numpy as np

        never = np.uint64(2**64 - 1)
        before = np.concatenate([[never], self.node2[:-1]]) if len(self.node2) else self.node2
        return np.where(self.first, never, before), self.rank2

    def trigram_answers(self, answers) -> None:
        self.share3, self.left3, _, _ = self._spread(answers, *self.trigrams(), False)

    def _spread(self, answers, context, successor, nodes: bool):
        """Answers to the distinct pairs, laid out over the tokens; the last two only if ``nodes`` are wanted."""
        import numpy as np

        n = len(context)
        share, left = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        node, rank = (np.full(n, 2**64 - 1, np.uint64), np.full(n, UNKNOWN, np.uint64)) if nodes else (None, None)
        asked, pairs, inverse = distinct_pairs(context, successor)
        del pairs
        if len(asked):
            ordered = sorted(answers, key=lambda a: a["share"])
            parts = [unpack_columns(a["found"]) for a in ordered]
            gather = lambda c: np.concatenate([p[c] for p in parts])
            share[asked], left[asked] = gather("share_code")[inverse], gather("left_code")[inverse]
            if nodes:
                places = gather("rank")
                base = np.repeat(np.array([a["share"] << RANK_BITS for a in ordered], np.int64), [len(p["rank"]) for p in parts])
                named = np.where(places >= 0, (base + gather("start") + places + 1).astype(np.uint64), np.uint64(2**64 - 1))
                node[asked] = named[inverse]
                rank[asked] = np.where(places >= 0, places.astype(np.uint64), np.uint64(UNKNOWN))[inverse]
        return share, left, node, rank

    def probabilities(self, learned: int, vocabulary: int):
        """(unigram, interpolated trigram) probability of each token. A context that was never learned leaves everything."""
        import numpy as np

        left = restore(np.arange(256))
        left[0] = 1.0
        p1 = (self.count + 0.5) / (learned + 0.5 * (vocabulary + 1))
        return p1, restore(self.share3) + left[self.left3] * (restore(self.share2) + left[self.left2] * p1)


def distinct(values):
    """(distinct numbers in order, which of them each number is): by hashing, so that only distinct numbers are sorted."""
    import numpy as np

    found, numbers = pd.factorize(values)
    order = np.argsort(numbers)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return numbers[order], place[found]


def distinct_pairs(context, successor):
    """(places that ask, (contexts, successors) sorted and distinct, which of them each place asks)."""
    import numpy as np

    asked = np.flatnonzero(context != np.uint64(2**64 - 1))
    contexts, c = distinct(context[asked])
    successors, s = distinct(successor[asked])
    keys, inverse = distinct(c.astype(np.uint64) * np.uint64(max(1, len(successors))) + s.astype(np.uint64))
    width = np.uint64(max(1, len(successors)))
    return asked, (contexts[(keys // width).astype(np.int64)], successors[(keys % width).astype(np.int64)]), inverse


def cut_by_share(numbers, parts: int):
    """Bounds of each share in sorted numbers."""
    import numpy as np

    return np.searchsorted(numbers >> np.uint64(RANK_BITS), np.arange(parts + 1, dtype=np.uint64))


def word_questions(runs: DataFrame, parts: int) -> DataFrame:
    """(share, run, asked): word hashes of a share with their counts in the run's documents to learn from."""
    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                run = Run(*[batch.column(c)[i].as_py() for c in (1, 2, 3)])
                counts = np.bincount(run.words[run.learn], minlength=len(run.hashes))
                share = ((run.hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.searchsorted(share, np.arange(parts + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(cuts))
                yield pa.record_batch([
                    pa.array(own, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()),
                    pa.array([squeeze(run.hashes[cuts[p] : cuts[p + 1]]) for p in own], pa.binary()),
                    pa.array([pack_columns(n=counts[cuts[p] : cuts[p + 1]].astype(np.int32)) for p in own], pa.binary())],
                    ["share", "run", "hashes", "counts"])

    return runs.select("run", "docs", "tokens", "hashes").mapInArrow(ask, "share int, run long, hashes binary, counts binary")


def word_answers(group: pd.DataFrame) -> pd.DataFrame:
    """Total counts and numbers of a share's words; the first run's answer also tells how many words were learned."""
    import numpy as np

    share = int(group["share"].iloc[0])
    lists = [unsqueeze(x) for x in group["hashes"]]
    counts = np.concatenate([unpack_columns(x)["n"] for x in group["counts"]])
    words, inverse = distinct(np.concatenate(lists))
    total = np.bincount(inverse, weights=counts).astype(np.int64)
    learned = total > 0
    number = np.where(learned, np.uint64(share << RANK_BITS) + np.cumsum(learned).astype(np.uint64), np.uint64(UNKNOWN))
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    found = [pack_columns(count=total[i], number=number[i]) for i in np.split(inverse, cuts)]
    return pd.DataFrame({"run": group["run"], "share": group["share"], "found": found,
                         "learned": [int(learned.sum())] + [0] * (len(group) - 1)})


def pair_questions(asking: DataFrame, order: int, parts: int) -> DataFrame:
    """(share, run, contexts, sizes, asked): distinct pairs of a run by the share that owns their context, with counts."""
    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                free()
                run = answered(batch, i, order - 1)
                asked, (context, successor), inverse = distinct_pairs(*(run.bigrams() if order == 2 else run.trigrams()))
                counts = np.bincount(inverse, weights=run.learn[asked], minlength=len(context)).astype(np.int32)
                cuts = cut_by_share(context, parts)
                own = np.flatnonzero(np.diff(cuts))
                rows = []
                for p in own:
                    a, b = cuts[p], cuts[p + 1]
                    new = np.flatnonzero(np.concatenate([[True], context[a + 1 : b] != context[a : b - 1]]))
                    rows.append((squeeze(context[a:b][new]), np.diff(np.append(new, b - a)).astype(np.int32), squeeze(successor[a:b]), counts[a:b]))
                yield pa.record_batch([
                    pa.array(own, pa.int32()), pa.array([batch.column(0)[i].as_py()] * len(own), pa.int64()),
                    pa.array([r[0] for r in rows], pa.binary()), pa.array([pack_columns(n=r[1]) for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()), pa.array([pack_columns(n=r[3]) for r in rows], pa.binary())],
                    ["share", "run", "contexts", "sizes", "successors", "counts"])

    return asking.mapInArrow(ask, "share int, run long, contexts binary, sizes binary, successors binary, counts binary")


def pair_answers(least: int, discount: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Build the share's part of the trie and answer every run from it."""
        import numpy as np

        sizes = [unpack_columns(x)["n"] for x in group["sizes"]]
        context = np.concatenate([np.repeat(unsqueeze(x), n) for x, n in zip(group["contexts"], sizes)])
        successor = np.concatenate([unsqueeze(x) for x in group["successors"]])
        counts = np.concatenate([unpack_columns(x)["n"] for x in group["counts"]])
        order = np.lexsort((successor, context))
        new = np.concatenate([[True], (context[order[1:]] != context[order[:-1]]) | (successor[order[1:]] != successor[order[:-1]])])
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        context, successor = context[order][new], successor[order][new]
        level = Level(context, successor, np.bincount(pair, weights=counts).astype(np.int64), least, discount)
        first = np.concatenate([[True], context[1:] != context[:-1]])
        owner = np.cumsum(first) - 1
        number, left, start = (x[owner] for x in level.contexts_of(context[first]))
        node = level.nodes_of(number, successor)
        codes, many = level.values_of(node)
        rank = np.where(many, node - start, -1).astype(np.int32)
        found = []
        for part in np.split(pair, np.cumsum([int(n.sum()) for n in sizes])[:-1]):
            found.append(pack_columns(share_code=codes[part], left_code=left[part], start=start[part], rank=rank[part]))
        return pd.DataFrame({"run": group["run"], "share": group["share"], "found": found})

    return run


ANSWERS = "run long, share int, found binary"


def answered(batch, i: int, order: int) -> Run:
    """The run of row i, with the answers of the first orders (columns after docs, tokens and hashes)."""
    run = Run(*[batch.column(c)[i].as_py() for c in (1, 2, 3)])
    for n, take in zip(range(order), (run.word_answers, run.bigram_answers, run.trigram_answers)):
        take(batch.column(4 + n)[i].as_py() or ())
    return run


def score_texts(docs: DataFrame, learn: Column, method: TrigramMethod = TrigramMethod(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (unigrams) and ``score``, both log10.

    ``learn`` says which rows the model is learned from; all rows are scored.
    """
    buckets = partitions(docs)
    runs = tokenised(docs, learn, method, id_col, text_col)
    learned, size = runs.agg(F.sum("learned"), F.sum("n_bytes")).first()
    parts = per_gigabyte(size or 0, method.share_bytes, buckets)

    def kept(answers: DataFrame, label: str, *more) -> DataFrame:
        return bucketed(answers.groupBy("run").agg(F.collect_list(F.struct("share", "found")).alias(label), *more), f"lm-{label}", "run", buckets)

    words = word_questions(runs, parts).groupBy("share").applyInPandas(word_answers, ANSWERS + ", learned long")
    words = kept(words, "words", F.sum("learned").alias("vocabulary"))
    vocabulary = words.agg(F.sum("vocabulary")).first()[0]
    state = runs.select("run", "docs", "tokens", "hashes").join(words.select("run", "words"), "run", "left")
    bigrams = kept(pair_questions(state, 2, parts).groupBy("share").applyInPandas(pair_answers(1, method.discount), ANSWERS), "bigrams")
    state = state.join(bigrams, "run", "left")
    trigrams = answers_by_run(pair_questions(state, 3, parts).groupBy("share").applyInPandas(pair_answers(2, method.discount), ANSWERS),
                              "share", "found")
    schema = with_id(docs, id_col, "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return state.join(trigrams, "run", "left").mapInArrow(_scorer(learned or 0, vocabulary or 0, schema), schema)


def _scorer(learned: int, vocabulary: int, schema):
    names = schema.fieldNames()

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                free()
                run = answered(batch, i, 3)
                p1, p = run.probabilities(learned, vocabulary)
                ends = np.cumsum(run.sizes)
                add = lambda x: np.add.reduceat(x, ends - run.sizes)
                yield pa.record_batch([run.docs.column(0).combine_chunks(), pa.array(run.sizes), pa.array(add((run.count > 0).astype(np.int64))),
                                       pa.array(np.full(len(ends), learned, np.int64)), pa.array(add(np.log10(p1))), pa.array(add(np.log10(p)))], names)

    return score
