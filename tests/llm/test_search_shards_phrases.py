"""Ranked search, sharding and phrases against brute force, with the odd cases each of them defines."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck, kinds, table_of
from pyspark.sql import functions as F

from alertlake.llm import collocations, lexical, quotient_filter as Q, sharding
from alertlake.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside, or in their results.
EXTRA = ("id string, item string, score string, rank string, shard string, slot string, w string, f string, run string, n string, part string, "
         "path string, index string, words string, word string, bits string, share string, body string, ids string, term string, bucket string")
SCHEMA = f"doc_id long, text string, lang string, {EXTRA}"
NAMES = EXTRA.count(",") + 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sample():
    rng = random.Random(8)
    words = ["stone", "River", "cloud", "the", "of", "and", "lamp", "été", "Über", "x1", "İ", "straße"]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "-", "\x85"]) for _ in range(n))
    copy = prose(30)
    texts = [None, "", "...", " \n", copy, copy, copy, "the", "THE the", prose(6000), "x" * 5000, "a b c d " * 40, "\0 \0 \0"]
    return texts + [prose(rng.randint(1, 80)) for _ in range(70)]


def frame(spark, texts, ids=None, langs=None):
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else [None, "en", "de", "und"][i % 4], *["x"] * NAMES) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_equal_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    cursor = duck(FOLDER).execute(SQL[name])
    columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert table_of(df.columns, got) == table_of(columns, want) and kinds(df.columns, got) == kinds(columns, want)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_collocations"])
def test_query_equals_sql(spark, name):
    rows_equal_sql(spark, name)


# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, top):
    """docs: (id, text); items: (id, text). Rows (item id, rank, doc id, score)."""
    found = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if t]
    found = [(i, c) for i, c in found if c]
    n, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(w for _, c in found for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                        for w, q in Counter(TERM.findall(lower(text or ""))).items() if w in c)
            if score > 0:
                scores.append((-score, i is None, i, score))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(sorted(scores, key=lambda s: s[:2] + (s[2] or 0,))[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "Stone river lamp"), (2, "the THE of of of x1"), (2, "été"), (3, None), (4, ""), (5, "unknown words"), (None, "straße cloud; lamp"), (6, "a b c d")]


@pytest.mark.parametrize(("shard_docs", "size", "top", "item_block"), [(2048, 24, 10, 1024), (7, 2, 3, 3), (20, 3, 1, 2), (30, 4, 200, 1024)])
def test_search(spark, monkeypatch, shard_docs, size, top, item_block):
    monkeypatch.setattr(lexical.item_blocks, "__defaults__", (item_block, 1 << 20))
    texts = sample()
    ids = [None if i == 9 else 4 if i in (5, 6) else i for i in range(len(texts))]
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")
    found = lexical.search(frame(spark, texts, ids), items, top, first=2, shard_docs=shard_docs, size=size)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_ranks(list(zip(ids, texts)), ITEMS, top)


def test_search_empty(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty(spark), items).collect() == []
    found = lexical.search(frame(spark, sample()), items.limit(0))
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(frame(spark, [None, "", "--"]), items).collect() == []


def test_blocks_are_skipped_and_bounds_hold():
    """On texts of several kinds, some blocks are skipped; no document's score is above its block's bound."""
    rng = random.Random(4)
    kinds_ = [[f"k{k}w{j}" for j in range(30)] for k in range(6)]
    texts = [" ".join([*(rng.choice(kinds_[i % 6]) for _ in range(rng.randint(5, 60))), "common"]) for i in range(600)]
    counted = [Counter(lexical.terms_of(t.encode())) for t in texts]
    items = [Counter(t.encode() for t in rng.sample(own, 8) + ["common"]) for own in kinds_]
    terms = sorted(set().union(*items))
    place = {t: i for i, t in enumerate(terms)}
    df = np.array([sum(t in c for c in counted) for t in terms])
    stats = lexical.Statistics(600, sum(sum(c.values()) for c in counted), terms, np.floor(1000 * np.log(1202 / (2 * df + 1))).astype(np.int64))
    asked = [np.array([place[t] for t in c]) for c in items]
    own = [Counter({w: n for w, n in c.items() if w in place}) for c in counted]
    body = lexical.shard_index(own, [sum(c.values()) for c in counted], stats, place, asked, 8)
    packed = lexical.pickle.dumps({k: (v.dtype.str, lexical.planes(v)) for k, v in body.items()})
    shard = lexical.Shard(list(range(600)), packed, len(terms), asked)
    blocks = skipped = 0
    for terms_, counts in zip(asked, items):
        best = []
        a, b = shard.search(terms_, stats.weights[terms_] * np.array(list(counts.values())), best, 10, 0)
        blocks, skipped = blocks + a, skipped + b
        assert len(best) == 10
    assert 0 < skipped < blocks
    for c, near in enumerate(shard.near):
        for i, bound in enumerate(shard.tops[c]):
            assert (shard.exact[np.ix_(shard.block(c, i), near)].max(axis=0) == bound).all()


# ---- sharding

@pytest.mark.parametrize(("shards", "cell_rows"), [(7, 1 << 16), (3, 4), (200, 5), (1, 10)])
def test_shards(spark, shards, cell_rows):
    texts = sample()
    docs = frame(spark, texts, [None if i % 9 == 0 else i // 2 for i in range(len(texts))]).withColumn("mark", F.lit("m"))
    found = sharding.shuffle_into_shards(docs, shards, cell_rows=cell_rows)
    rows = found.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["mark"] == "m"
    sizes = [len(slots[j]) for j in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_twice_and_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    place = lambda df: {(r["doc_id"], r["shard"], r["slot"]) for r in df.collect()}
    first = place(sharding.shuffle_into_shards(docs, 9, in_place=True))
    assert first == place(sharding.shuffle_into_shards(docs, 9, in_place=True)) != place(sharding.shuffle_into_shards(docs, 9, seed=1, in_place=True))
    assert sharding.shuffle_into_shards(empty(spark), 4).collect() == []
    written = sharding.write_shards(docs, str(tmp_path / "out"), 9, in_place=True)
    assert place(written) == first
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs.where("doc_id % 2 = 0"), 9, in_place=True)


def test_hypergeometric_is_exact():
    """Draws follow the distribution: chi-squared against exact probabilities, and sums of a huge case."""
    rng = np.random.default_rng(3)
    good, bad, draws = 12, 20, 9
    seen = Counter(sharding.hypergeometric(good, bad, draws, rng) for _ in range(6000))
    chi = 0
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        chi += (seen[k] - 6000 * p) ** 2 / (6000 * p)
    assert chi < 30  # nine degrees of freedom: one in 2000
    big = [sharding.hypergeometric(10**10, 3 * 10**10, 10**9, rng) for _ in range(200)]
    spread = (10**9 * 0.25 * 0.75 * (1 - 1 / 40)) ** 0.5
    assert abs(np.mean(big) - 2.5e8) < 5 * spread / 200**0.5 and 0.7 < np.std(big) / spread < 1.3


def test_tables_and_permutations():
    rows, columns = [3, 0, 50, 7], [20, 20, 20]
    table = sharding.random_table(rows, columns, [1])
    assert table.sum(axis=1).tolist() == rows and table.sum(axis=0).tolist() == columns
    for size in (1, 2, 3, 17, 1000):
        to = sharding.permuted(np.arange(size), np.full(size, size), np.full(size, 5, np.uint64))
        assert sorted(to.tolist()) == list(range(size))


def test_shuffle_is_uniform():
    """Over many seeds, a row's shard and slot are evenly spread, and neighbours part."""
    parts = [(f"f{i}", 100 + i, n) for i, n in enumerate([5, 1, 9, 3])]
    names = np.repeat([100, 101, 102, 103], [5, 1, 9, 3])
    index = np.concatenate([np.arange(n) for n in [5, 1, 9, 3]])
    place, together = np.zeros((18, 18)), 0
    for seed in range(2000):
        shard, slot = sharding.plan_of(parts, 3, seed).place(names, index, {})
        at = shard * 6 + slot
        assert sorted(at.tolist()) == list(range(18))
        place[np.arange(18), at] += 1
        together += shard[0] == shard[1]
    expected = 2000 / 18
    assert ((place - expected) ** 2 / expected).sum() < 18 * 17 + 5 * (2 * 18 * 17) ** 0.5
    assert abs(together / 2000 - 5 / 17) < 0.05


# ---- phrases

def brute_phrases(rows, least, top, percent):
    """rows: (lang, text). Result rows in order."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cand.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= percent * counts[p[i : i + k]]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "run_bytes", "room", "fan"), [(30, 2000, 1 << 22, 1 << 21, 10), (2, 2000, 700, 40, 10), (3, 5, 2000, 16, 2), (1, 50, 500, 3, 1)])
def test_phrases(spark, monkeypatch, least, top, run_bytes, room, fan):
    monkeypatch.setattr(collocations, "FAN", fan)
    texts = sample()
    found = collocations.collocations(frame(spark, texts), least, top, 80, run_bytes=run_bytes, room=room)
    langs = [[None, "en", "de", "und"][i % 4] for i in range(len(texts))]
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(zip(langs, texts), least, top, 80)


def test_phrases_empty(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    assert collocations.collocations(frame(spark, [None, "", "..", " "])).collect() == []


@pytest.mark.parametrize(("n", "width"), [(2, 1), (2, 9), (3, 5), (3, 14), (4, 16), (4, 24), (3, 31), (4, 31)])
def test_quotient_filter_round_trip(n, width):
    rng = np.random.default_rng(n * 100 + width)
    words = rng.integers(0, 1 << width, (3000, n))
    words[::3] = words[0]
    high, low = Q.permute(*Q.packed(words, width), n, width)
    assert (Q.unpacked(*Q.restore(high, low, n, width), n, width) == words).all()
    parts = [Q.counted(high[i::4], low[i::4], np.ones(len(high[i::4]), np.int64), n, width) for i in range(4)]
    filters = [Q.build(*p, n, width, 0, 0) for p in parts]
    for f, p in zip(filters, parts):
        assert all((a == b).all() for a, b in zip(Q.entries(f), p))
    want = Counter(map(tuple, words.tolist()))
    high, low, counts = Q.merge(filters)
    assert dict(zip(map(tuple, Q.unpacked(*Q.restore(high, low, n, width), n, width).tolist()), counts.tolist())) == want
    bits = min(3, Q.halves(n, width)[0])
    back = [np.concatenate(c) for c in zip(*(Q.entries(f) for _, f in Q.cut(high, low, counts, n, width, bits)))]
    assert all((a == b).all() for a, b in zip(back, (high, low, counts)))


def test_numbering_is_dense(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET", 50)
    rows = collocations.numbered(spark.createDataFrame([(f"w{i}",) for i in range(500)], "word string")).collect()
    ids = [r["id"] for r in rows]
    assert len(set(ids)) == 500 and min(ids) >= 1 and max(ids) < 500 * 4


# ---- names that clash, and short benchmark items

CLASH = "n_lines string, n_removed string, _print string, row string, body string, cut string, r1 string, r2 string, id string, fp string, component_id string"


def clashing(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    foot = "a footer line that stands on every site"
    rows = [(i // 2 if i < 8 else i, " ".join(rng.choice(words) for _ in range(40)) + "\n" + foot, "en", f"s{i % 7}", 1, *["x"] * (CLASH.count(",") + 1))
            for i in range(40)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def test_stages_with_clashing_names(spark):
    import corpus_pipeline

    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == 40 and {r["n_lines"] for r in rows} == {"x"}
        if name == "line dedup":
            assert sum("footer" in r["text"] for r in rows) == 2 and all(r["n_chars"] == len(r["text"]) for r in rows if "footer" not in r["text"])
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), FOLDER).collect() == [] or name == ""


def test_line_counts_replace_columns(spark):
    from alertlake.llm import lines

    found = lines.dedup_lines(clashing(spark))
    assert found.columns.count("n_lines") == 1 and found.schema["n_lines"].dataType.simpleString() == "bigint"


def test_short_items_stand_at_word_edges(spark):
    from alertlake.llm import decontaminate

    items = spark.createDataFrame([(1, "Tiny item"), (2, " \n"), (3, "x1")], "item_id int, text string")
    made = ["a tiny\titem.", "a tiny items list", "destiny item", "x1", "ax1 x12", "tiny item", " ", "x1,x1", "tinyitem"]
    docs = frame(spark, made)
    got = {(r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(0, 1, 0, 2, 11), (3, 3, 0, 0, 2), (5, 1, 0, 0, 9), (7, 3, 0, 0, 2)}
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()) == [1, 2, 4, 6, 8]
