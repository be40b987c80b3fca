"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its letter n-grams, hashed to buckets; word edges count as a letter. Embeddings and the
softmax are trained together by stochastic gradient descent on a sample of at most ``per_language`` labelled texts of each
language (the order of a hash of the id picks them; the whole texts count, as bucket counts). A part of the sample that training
doesn't see fits a temperature and the least confidence at which a prediction is accepted.

For prediction the embeddings are multiplied by the softmax weights once, so a text needs the mean of a few numbers per n-gram.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and isn't learned from; without labelled texts
everything is ``und``; one language alone is always predicted with score 1; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm.common import id_and_text, slices, with_id

#: Parts of a language whose least hashes are found before those of the whole.
SALTS = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageMethod:
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    buckets_log2: int = 15
    dimensions: int = 16
    per_language: int = 600
    epochs: int = 12
    rate: float = 2.0
    max_error: float = 0.01
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    """weights: bucket x language, as float32; accept: least score of an accepted prediction."""

    languages: tuple[str, ...]
    weights: bytes
    bias: tuple[float, ...]
    accept: float


def letter_table():
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[bytes | None], method: LanguageMethod, letters) -> list:
    """For each text the buckets of its n-grams (repeats included)."""
    import numpy as np

    lowered = [x.decode("utf-8", "replace").lower() if x else "" for x in texts]
    ends = np.cumsum([len(x) + 1 for x in lowered])
    code = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letters[code], code, 0).astype(np.uint32)
    letter = code != 0
    starts = np.concatenate([[0], ends[:-1]])
    found = [[] for _ in texts]
    for n in method.sizes:
        m = len(code) - n + 1
        if m <= 0:
            continue
        key = np.full(m, n, np.uint32)
        for j in range(n):
            key = key * np.uint32(0x01000193) + code[j : m + j]
        good = letter[:m] | letter[n - 1 :] if n < 3 else np.ones(m, bool)
        for j in range(1, n - 1):
            good &= letter[j : m + j]
        at = np.flatnonzero(good)
        bucket = (key[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - method.buckets_log2)
        bounds = np.append(np.searchsorted(at, starts), len(at))
        for i in range(len(texts)):
            found[i].append(bucket[bounds[i] : bounds[i + 1]])
    return [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in found]


def training_sample(docs: DataFrame, train: Column, method: LanguageMethod, id_col: str, text_col: str, lang_col: str):
    """(language, buckets, counts) of the sampled texts; bounded by per_language x languages x buckets."""
    known = docs.where(train & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    salted = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("chosen"), F.xxhash64(F.col(id_col)).alias("order"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(SALTS)))
    # First the least of each salt, then of every eighth salt, then of the language: at most eight times the sample meets in a last task.
    for salt in (F.col("salt"), F.col("salt") % 8, F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("lang", salt).orderBy("order", "chosen"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= method.per_language).drop("rank")
    chosen = salted.select("chosen").distinct()
    picked = (id_and_text(known, id_col, text_col, F.col(lang_col).cast("string").alias("lang"))
              .join(F.broadcast(chosen), F.col("id") == F.col("chosen"), "left_semi").select("lang", "text"))

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        letters = letter_table()
        for part, texts in slices(batches, 64):
            counted = [np.unique(x, return_counts=True) for x in subwords(texts, method, letters)]
            yield pa.record_batch([part.column(0), pa.array([b.astype(np.int32).tobytes() for b, _ in counted]),
                                   pa.array([c.astype(np.int32).tobytes() for _, c in counted])], ["lang", "buckets", "counts"])

    rows = picked.mapInArrow(count, "lang string, buckets binary, counts binary").collect()
    return sorted(tuple(r) for r in rows if r["buckets"])


def train_model(rows: list, method: LanguageMethod) -> LanguageModel | None:
    """Stochastic gradient descent over the sampled texts, then calibration on every fourth of them."""
    import numpy as np

    if not rows:
        return None
    languages = tuple(sorted({r[0] for r in rows}))
    target = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(method.seed)
    texts = []
    for lang, buckets, counts in rows:
        share = np.frombuffer(counts, np.int32).astype(np.float64)
        texts.append((target[lang], np.frombuffer(buckets, np.int32), share / share.sum()))
    order = rng.permutation(len(texts))
    aside = order[::4] if len(texts) >= 8 else order
    learn = np.setdiff1d(order, aside) if len(texts) >= 8 else order
    embed = rng.normal(0, 1, (1 << method.buckets_log2, method.dimensions))
    weight, bias = np.zeros((method.dimensions, len(languages))), np.zeros(len(languages))
    steps, done = method.epochs * len(learn), 0
    for _ in range(method.epochs):
        for i in rng.permutation(learn):
            y, buckets, share = texts[i]
            rate = method.rate * (1 - done / steps)
            own = embed[buckets]
            hidden = share @ own
            error = softmax(hidden @ weight + bias)
            error[y] -= 1
            back = weight @ error
            weight -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            embed[buckets] = own - 10 * rate * np.outer(share, back)
            done += 1
    folded = embed @ weight
    scores = np.array([texts[i][2] @ folded[texts[i][1]] + bias for i in aside])
    truth = np.array([texts[i][0] for i in aside])
    loss = lambda t: -np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    heat = min(np.geomspace(0.05, 20, 60), key=loss)
    sure = softmax(scores / heat)
    return LanguageModel(languages, (folded / heat).astype(np.float32).tobytes(), tuple((bias / heat).tolist()),
                         least_confidence(sure.max(axis=1), sure.argmax(axis=1) == truth, method.max_error))


def softmax(x):
    import numpy as np

    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def least_confidence(confidence, right, max_error: float) -> float:
    """The least confidence at which, with one error added, accepted predictions err in at most ``max_error`` of the cases."""
    import numpy as np

    order = np.argsort(-confidence, kind="stable")
    wrong = (np.cumsum(~right[order]) + 1) / (np.arange(len(order)) + 1 + 1)
    fits = np.flatnonzero(wrong <= max(max_error, 1.5 / (len(order) + 1)))
    return float(confidence[order[fits[-1]]]) if len(fits) else 1.0


def fit(docs: DataFrame, train: Column, method: LanguageMethod = LanguageMethod(), id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> LanguageModel | None:
    """``train`` says which rows may be learned from."""
    return train_model(training_sample(docs, train, method, id_col, text_col, lang_col), method)


def identify(docs: DataFrame, model: LanguageModel | None, method: LanguageMethod = LanguageMethod(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per document: id, ``lang_pred`` (the likeliest language), ``score`` (its calibrated probability) and ``accepted``."""
    schema = with_id(docs, id_col, "lang_pred string, score double, accepted boolean")
    names = schema.fieldNames()

    def predict(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        letters = letter_table()
        weights = np.frombuffer(model.weights, np.float32).reshape(-1, len(model.languages)) if model else None
        for part, texts in slices(batches):
            langs, scores = [], []
            for buckets in subwords(texts, method, letters) if model else [()] * len(texts):
                if not len(buckets):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(buckets) < len(weights):
                    total = weights[buckets].sum(axis=0, dtype=np.float64)
                else:
                    total = np.bincount(buckets, minlength=len(weights)) @ weights.astype(np.float64)
                chance = softmax(total / len(buckets) + np.array(model.bias))
                best = int(chance.argmax())
                langs.append(model.languages[best])
                scores.append(float(chance[best]))
            accepted = [x != UNKNOWN and s >= model.accept for x, s in zip(langs, scores)]
            yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                   pa.array(accepted, pa.bool_())], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(predict, schema)
