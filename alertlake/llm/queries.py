"""The registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm import collocations, decontaminate, language, lexical, license_scan, lines, ngram_lm, packing, quality, secret_scan, sharding, simhash, suffixes
from alertlake.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return add


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def fold_of(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op1_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = language.identify(docs, language.fit(docs, fold_of(3) != 1))
    return found.withColumn("held_out", F.coalesce(fold_of(3) == 1, F.lit(False)))


@query("op2_suffix_dedup")
def without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read_table(spark, folder, "documents"), word_bpe())


@query("op4_simhash")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_lm_scoring")
def scored(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return ngram_lm.score_texts(docs, fold_of(5) != 1).withColumn("held_out", F.coalesce(fold_of(5) == 1, F.lit(False)))


@query("op6_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = secret_scan.scan(docs, secret_scan.thresholds(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.written(F.array_sort(F.concat("base", "random"))).alias("spans"))


@query("op7_licenses")
def licenses(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    found = license_scan.license_scan(docs, license_scan.document_frequency(docs))
    starts, labels = F.col("base.start"), lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(F.col("base.label")).alias("base_labels"),
                        labels(F.concat("base.label", "found.label")).alias("labels"),
                        F.coalesce(F.array_max("found.score"), F.lit(0.0)).alias("score"))


LINE_SQL = """
WITH rows AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM parts),
wide AS (SELECT key, min((doc_id, pos)) AS first FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 5),
judged AS (SELECT keyed.*, wide.key IS NOT NULL AND (doc_id, pos) <> wide.first AS gone FROM keyed LEFT JOIN wide ON keyed.key = wide.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""


@query("op8_line_dedup", LINE_SQL)
def kept_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(read_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op9_decontamination")
def leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op10_quality")
def judged(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return quality.quality_rules(docs, quality.fit(docs, read_table(spark, folder, "labels")))


SEARCH_SQL = r"""
WITH terms AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS d FROM documents),
docs AS (SELECT d, doc_id, len(w) AS n, w FROM terms WHERE len(w) > 0),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM docs),
asked AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text,
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
found AS (SELECT d, doc_id, n, term, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, sums GROUP BY term, docs),
shares AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))) AS s FROM found JOIN weights USING (term), sums),
scores AS (SELECT i, item_id, d, doc_id, CAST(sum(q * s) AS BIGINT) AS score FROM asked JOIN shares USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical_search", SEARCH_SQL)
def searched(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op12_sharding")
def sharded(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shuffle_into_shards(read_table(spark, folder, "documents"), 40, in_place=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT row_number() OVER () AS p, lang, string_split_regex(piece, '[\x20\x09]+') AS w FROM pieces),
words AS (SELECT p, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists),
rows AS (SELECT lang, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d
         FROM words WHERE word <> '' WINDOW o AS (PARTITION BY p ORDER BY i)),
counts AS (SELECT lang, 1 AS words, a AS phrase, count(*) AS f FROM rows GROUP BY ALL
           UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM rows WHERE b IS NOT NULL GROUP BY ALL
           UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM rows WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
           UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d, count(*) FROM rows WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 30),
keyed AS MATERIALIZED (SELECT lang || chr(1) || phrase AS key, f FROM counts),
halves AS MATERIALIZED (SELECT lang, phrase, f, k, lang || chr(1) || array_to_string(w[1 : k], ' ') AS lkey,
                               lang || chr(1) || array_to_string(w[k + 1 : words], ' ') AS rkey
                        FROM cand CROSS JOIN (VALUES (1), (2), (3)) AS places(k) WHERE k < words),
cuts AS (SELECT h.lang, h.phrase, h.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * h.f) // (l.f + r.f) AS score
         FROM halves h JOIN keyed l ON l.key = h.lkey JOIN keyed r ON r.key = h.rkey),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, f, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM cand
          CROSS JOIN (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS places(i, size) WHERE size < words AND i + size - 1 <= words),
gone AS (SELECT DISTINCT lang, phrase FROM parts JOIN cand USING (lang, phrase) WHERE 100 * parts.f >= 80 * cand.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN totals USING (lang) ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""


@query("op13_collocations", PHRASE_SQL)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
