"""What is sampled, remembered or estimated from little: bounds that hold, and the same results within them."""

import random
import string

from pyspark.sql import functions as F

from alertlake.llm import language, packing, secret_scan
from alertlake.llm.queries import word_bpe


def test_language_sample_is_the_least_hashes_of_a_language(spark, monkeypatch):
    rows = [(i % 170, f"some words numbered {'abcdefghij'[i % 10]} {i % 170}", ["en", "de", "fr"][i % 3] if i % 7 else None) for i in range(400)]
    rows += [(None, "no id", "en"), (5, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("z") for c in ("salt", "rank", "order", "chosen", "id")}).repartition(6)
    method = language.LanguageMethod(per_language=9)
    salted = language.training_sample(docs, F.lit(True), method, "doc_id", "text", "lang")
    monkeypatch.setattr(language, "SALTS", 1)
    assert salted == language.training_sample(docs, F.lit(True), method, "doc_id", "text", "lang")
    least = {}
    for lang, doc_id in (docs.where("lang is not null and doc_id is not null and text is not null").orderBy(F.xxhash64("doc_id"), "doc_id")
                         .select("lang", "doc_id").collect()):
        least.setdefault(lang, []).append(doc_id)
    chosen = {i for ids in least.values() for i in ids[:9]}
    assert len(salted) == sum(lang is not None and doc_id in chosen and text is not None for doc_id, text, lang in rows)


def test_remembered_words_are_bounded_by_bytes(monkeypatch):
    made = []
    memory = packing.Recent(lambda key: made.append(key) or b"v" * 100)
    monkeypatch.setattr(packing, "CACHED", 40_000)
    for _ in range(3):
        for i in range(500):
            assert memory[f"key {i}"] == b"v" * 100
    assert sum(len(k) + len(v) + packing.ENTRY for part in (memory, memory.older) for k, v in part.items()) <= 40_000
    made.clear()
    for _ in range(5):
        memory["again"], memory["long" * 20]  # a long key is made each time and not kept
    assert made.count("again") == 1 and made.count("long" * 20) == 5 and "long" * 20 not in memory


def test_other_tokenizers_get_whole_texts():
    for name, by_word in ((word_bpe(), True), (word_bpe().replace("word_bpe_49k", "byte_bpe_50k"), False)):
        with open(name, encoding="utf-8") as f:
            ids = packing.WordIds(f.read())
        assert ids.by_word == by_word
        for text in ["It's  a\n\ntest of WORDS", " lead", "é ｆｕｌｌ 中文字 ½", "w" * 300 + " " + "中" * 200, ""]:
            assert ids.of(text.encode()).tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_lone_random_key_is_found(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(46)) for _ in range(60)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    p = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in keys], "t string").select("t", secret_scan.randomness(F.col("t"))).collect()}
    middling = [k for k in keys if 0.06 < p[k] < 0.5][:3] + [k for k in keys if p[k] > 0.6][:2]
    plain = " ".join(f"{w}1{w}2{w}3{w}4{w}5" for w in ("aaaa", "abab"))
    for key in middling:
        docs = spark.createDataFrame([(1, f"a {key} b"), (2, plain), (3, None)], "doc_id long, text string")
        found = {r["doc_id"]: r["random"] for r in secret_scan.scan(docs, secret_scan.thresholds(docs)).collect()}
        assert [tuple(s)[:3:2] for s in found[1]] == [(2, 48)] and not found[2] and not found[3]


def test_sparse_classes_borrow_from_their_neighbours():
    battery = secret_scan.Battery(bins=10, enough=6)
    sparse, rich = [9] + [0] * 9, [50] + [4] * 9
    by_class = {10: sparse, 11: rich, 15: [0] * 5 + [1] * 5}
    assert secret_scan.pooled(by_class, 11, battery) == (rich, True)
    bins, settled = secret_scan.pooled(by_class, 10, battery)
    assert settled and bins == [59] + [4] * 9
    bins, settled = secret_scan.pooled({10: sparse, 12: [0] * 9 + [1]}, 10, battery)
    assert not settled and bins == [9] + [0] * 8 + [1]
    assert secret_scan.least_p(rich, battery) == 0.1 and secret_scan.least_p(sparse, battery) is None
    slow = min(i for i in range(10) if 1 - 2 * 20 * (1 - i / 10) / sum(rich[i:]) <= 0.05)
    assert slow / 10 == 0.1
