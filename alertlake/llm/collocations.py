"""Collocations: phrases of two to four words whose weakest cut still holds together, counted with quotient filters.

1. Texts become runs per language: a list of the run's words with their counts, and the stream of numbers into it, zero at breaks.
2. Words are counted per language. Only words that occur often enough can stand in a candidate; these get numbers, and every run is told
   the numbers of its words by a join on the word (a run asks once for a word, so a common word is asked as often as there are runs).
3. Tasks turn streams into sorted counting quotient filters of their 2-, 3- and 4-grams, cut by leading bits, which are merged share by
   share. Shares are at most ``FAN`` times as fine in one round as in the round before, so pieces don't get small as the corpus grows.
4. Candidates are scored, and parts of longer candidates dropped, by joins on word numbers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlake.llm import quotient_filter as Q
from alertlake.llm.common import id_and_text, slices, store

LONGEST = 4
RUN_BYTES = 16 << 20
#: Entries that a task holds before it sends them, and that a share gets to merge, as expected.
ENTRIES = 1 << 21
#: Bits by which one round of merging may cut finer.
FAN = 10
#: Parts of a language that are ranked apart first.
PARTS = 16
#: Words per bucket of the numbering.
BUCKET = 1 << 16

BREAKS, BLANKS, BREAK = b".,;:!?\n\x0b\x0c\r", b" \t", b"\xff"
TABLE = bytes(0xFF if c in BREAKS else 0x20 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in order, with ``BREAK`` (no byte of UTF-8) between pieces."""
    return text.translate(TABLE).replace(BREAK, b" \xff ").split()


def in_runs(docs: DataFrame, lang_col: str, text_col: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, lang, words, counts, stream): texts of one language, about ``run_bytes`` of all languages at a time. Word i has number i + 1."""
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def rows() -> Iterator:
            nonlocal number
            for lang, texts in held.items():
                known = defaultdict(count(1).__next__)
                known[BREAK] = 0
                parts = []
                for text in texts:
                    parts.append(np.fromiter(map(known.__getitem__, words_of(text)), np.int32))
                    parts.append(np.zeros(1, np.int32))
                stream = np.concatenate(parts)
                del known[BREAK]
                words, counts = list(known), np.bincount(stream, minlength=len(known) + 1)[1:]
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                                       pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([zstandard.compress(stream.tobytes(), 1)], pa.binary())],
                                      ["run", "lang", "words", "counts", "stream"])
                number += 1

        for part, texts in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts):
                if text:
                    held[lang].append(text)
                    size += len(text)
                    if size >= run_bytes:
                        yield from rows()
                        held.clear()
                        size = 0
        yield from rows()

    rows = id_and_text(docs.withColumn(lang_col, F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))), lang_col, text_col)
    return store(rows.mapInArrow(read, "run long, lang string, words array<string>, counts array<long>, stream binary"), "phrase-runs")


def numbered(words: DataFrame) -> DataFrame:
    """(word, id): ids from 1, dense within buckets of hashes so that no task sorts more than a bucket."""
    words = store(words, "phrase-words")
    buckets = 1 << max(0, math.ceil(math.log2(max(1, words.count() / BUCKET))))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("word"))
    return words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets))).select("word", (place * buckets + F.col("bucket")).alias("id"))


def grams(ids: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The permuted n-grams of a stream of word ids that hold no zero."""
    windows = np.lib.stride_tricks.sliding_window_view(ids, n) if len(ids) >= n else np.zeros((0, n), np.int64)
    return Q.permute(*Q.packed(windows[(windows > 0).all(axis=1)], width), n, width)


def count_grams(runs: DataFrame, width: int, room: int = ENTRIES) -> DataFrame:
    """(lang, n, share, bits, filter): of rows (lang, stream, answers, bits), the filters of a task's n-grams, cut into shares."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        held: dict[tuple[str, int], list] = {}
        depth: dict[str, int] = {}

        def gathered(key) -> tuple:
            parts = held[key]
            if len(parts) > 1:
                held[key] = [Q.counted(*(np.concatenate(c) for c in zip(*parts)), key[1], width)]
            return held[key][0]

        def send(key) -> Iterator:
            lang, n = key
            bits = min(depth[lang], FAN, Q.halves(n, width)[0])
            cut = list(Q.cut(*gathered(key), n, width, bits))
            del held[key]
            if cut:
                yield pa.record_batch([pa.array([lang] * len(cut)), pa.array([n] * len(cut), pa.int32()), pa.array([s for s, _ in cut], pa.int64()),
                                       pa.array([bits] * len(cut), pa.int32()), pa.array([f for _, f in cut], pa.binary())],
                                      ["lang", "n", "share", "bits", "filter"])

        def entries() -> int:
            return sum(len(p[0]) for parts in held.values() for p in parts)

        for batch in batches:
            langs, depths = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            depth.update(zip(langs, depths))
            for lang, stream, answers in zip(langs, batch.column(1), batch.column(2)):
                own = np.frombuffer(zstandard.decompress(stream.as_py()), np.int32)
                names = np.zeros(int(own.max(initial=0)) + 1, np.int64)
                names[answers.values.field("place").to_numpy()] = answers.values.field("id").to_numpy()
                ids = names[own]
                for n in range(2, LONGEST + 1):
                    high, low = grams(ids, n, width)
                    if len(high):
                        held.setdefault((lang, n), []).append(Q.counted(high, low, np.ones(len(high), np.int64), n, width))
                if entries() > room:
                    for key in list(held):
                        gathered(key)
                while held and entries() > room // 2:
                    yield from send(max(held, key=lambda k: len(held[k][0][0])))
        for key in list(held):
            yield from send(key)

    return runs.select("lang", "stream", "answers", "bits").mapInArrow(run, "lang string, n int, share long, bits int, filter binary")


def finer(group: pd.DataFrame) -> pd.DataFrame:
    """The filters of one share merged and cut ``FAN`` bits finer, or as far as their language needs."""
    first = group.iloc[0]
    n, width, bits, _ = Q.shape(first["filter"])
    bits = min(first["wanted"], bits + FAN, Q.halves(n, width)[0])
    cut = list(Q.cut(*Q.merge(list(group["filter"])), n, width, int(bits)))
    return pd.DataFrame({"lang": first["lang"], "n": n, "share": [s for s, _ in cut], "bits": int(bits), "filter": [f for _, f in cut],
                         "wanted": first["wanted"]})


def frequent(least: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        n, width, _, _ = Q.shape(first["filter"])
        high, low, counts = Q.merge(list(group["filter"]))
        keep = counts >= least
        words = Q.unpacked(*Q.restore(high[keep], low[keep], n, width), n, width)
        return pd.DataFrame({"lang": first["lang"], "w": pd.Series(list(words), dtype=object), "f": counts[keep]})

    return run


def merged(pieces: DataFrame, wanted: DataFrame, deepest: int, least: int) -> DataFrame:
    """(lang, w, f): the n-grams that occur often enough in all filters together."""
    for _ in range(FAN, deepest, FAN):
        pieces = pieces.join(wanted.select("lang", F.col("bits").alias("wanted")), "lang") if "wanted" not in pieces.columns else pieces
        # A share that is cut further is merged in as many groups as it will have shares, so that none is larger than a last share.
        salt = F.pmod(F.xxhash64("filter"), F.lit(1).cast("long") * F.expr(f"shiftleft(1L, greatest(0, least(wanted - bits, {2 * FAN})))"))
        pieces = store(pieces.groupBy("lang", "n", "share", salt.alias("salt")).applyInPandas(
            finer, "lang string, n int, share long, bits int, filter binary, wanted int"), "phrase-filters")
    return pieces.groupBy("lang", "n", "share").applyInPandas(frequent(least), "lang string, w array<long>, f long")


def phrase_counts(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text",
                  run_bytes: int = RUN_BYTES, room: int = ENTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): (lang, w, f) of all phrases of one to four words that occur often enough, w being word ids; (id, word);
    and (lang, n), the number of words of a language."""
    runs = in_runs(docs, lang_col, text_col, run_bytes)
    asked = runs.select("run", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "of"))
    asked = asked.select("run", "lang", (F.col("place") + 1).alias("place"), F.col("of.words").alias("word"), F.col("of.counts").alias("c"))
    counts = store(asked.groupBy("lang", "word").agg(F.sum("c").alias("f")), "phrase-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    often = counts.where(F.col("f") >= least)
    words = store(numbered(often.select("word").distinct()), "phrase-ids")
    width = int(words.agg(F.max("id")).first()[0] or 1).bit_length()
    if width > 31:
        raise ValueError("more frequent words than 31 bits can number")
    known = often.join(words, "word").select("lang", "word", "id", "f")
    answers = asked.select("run", "lang", "place", "word").join(known.select("lang", "word", "id"), ["lang", "word"])
    answers = answers.groupBy("run").agg(F.collect_list(F.struct("place", "id")).alias("answers"))
    depth = totals.select("lang", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / room))).cast("int").alias("bits"))
    deepest = depth.agg(F.max("bits")).first()[0] or 0
    pieces = count_grams(runs.select("run", "lang", "stream").join(answers, "run").join(depth, "lang"), width, room)
    longer = merged(pieces, depth, deepest, least)
    ones = known.select("lang", F.array(F.col("id").cast("long")).alias("w"), "f")
    return store(ones.unionByName(longer), "phrases"), words, totals


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, w, a, l, r, score) of all phrases of two or more words, by their weakest cut."""
    of = lambda w, f: phrases.select("lang", F.col("w").alias(w), F.col("f").alias(f))
    cuts = phrases.where(F.size("w") > 1).select("lang", "w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("w", F.lit(1), F.col("k")), "right": F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))})
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + r) as long)")
    return (cuts.groupBy("lang", "w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
            .select("lang", "w", "a", "cut.l", "cut.r", "cut.score"))


def absorbed(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, w): phrases that lie in a longer one which occurs nearly as often."""
    def inside(n: int):
        return [F.slice("w", start, size) for size in range(2, n) for start in range(1, n - size + 2)]

    parts = [phrases.where(F.size("w") == n).select("lang", "f", F.explode(F.array(*inside(n))).alias("w")) for n in range(3, LONGEST + 1)]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    most = together.groupBy("lang", "w").agg(F.max("f").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    return most.join(phrases, ["lang", "w"]).where(wide("most") * 100 >= wide("f") * percent).select("lang", "w")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, lang_col: str = "lang", text_col: str = "text",
                 run_bytes: int = RUN_BYTES, room: int = ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of every language.

    Texts are cut at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words, A to Z lowered. A phrase of two to four
    words that occurs ``least`` times or more is scored by its weakest cut: floor(2,000,000 a / (l + r)) for its count a and the counts
    of the cut's parts. Phrases in a longer one with ``percent`` per cent of their count or more are left out. Ties go by count, then
    by the phrase's bytes.

    A null language counts as ``und``, a null text as empty; empty tables, and languages without a candidate, give no rows. Repeated rows
    count as often as they stand. Other columns play no part, whatever their names.
    """
    phrases, words, totals = phrase_counts(docs, least, lang_col, text_col, run_bytes, room)
    found = scored(phrases).join(absorbed(phrases, percent), ["lang", "w"], "left_anti")
    order = [F.desc("score"), F.desc("a")]
    # Parts of a language first, so that the task that ranks the whole gets a bounded number of rows besides ties.
    for key in (["lang", F.pmod(F.xxhash64("w"), F.lit(PARTS))], ["lang"]):
        found = found.withColumn("place", F.rank().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= top)
    spelt = (found.select("lang", "w", F.posexplode("w").alias("at", "id")).join(words, "id").groupBy("lang", "w")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    found = found.drop("place").join(spelt, ["lang", "w"]).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
