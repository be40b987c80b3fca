"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm import decontaminate, lines, packing, quality, simhash
from alertlake.llm.common import read_table, store, unused
from alertlake.llm.queries import word_bpe


def good_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and very short texts among them. A row that repeats is judged as its copy.

    With no labelled documents the fixed rules decide alone. An empty table stays empty, here and in every stage.
    """
    return quality.kept_documents(docs, quality.fit(docs, read_table(spark, folder, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Cross-site lines go, but for their first place; ``n_chars`` follows the text.

    Null texts stay; a null source is no site; repeated rows lose the same lines. Extra columns stay, whatever their names.
    """
    n_lines, n_removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    found = lines.dedup_lines(docs, n_lines=n_lines, n_removed=n_removed)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id, of its rows that with the smallest text hash.

    Null and wordless texts are copies of each other. A null id comes after all others.
    """
    return simhash.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null texts hold none, and null, empty or repeated items change nothing."""
    return decontaminate.clean_documents(docs, read_table(spark, folder, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is one end token; repeated rows are packed as often as they stand."""
    return packing.pack(docs, word_bpe(), room=ROOM)


#: Bytes of each of packing's two memories. Workers keep them while the other stages run, so they are smaller here than where packing is alone.
ROOM = 64 << 20

STAGES = [("quality rules", good_quality), ("line dedup", without_boilerplate), ("simhash near-dedup", one_of_near_copies),
          ("benchmark decontamination", without_leaks), ("packing", packed)]

#: SQL can express neither the log-likelihood verdicts nor fingerprints, edit distances and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if i < len(STAGES) - 1:
            docs = store(docs, f"stage-{i}")
    return docs
