"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next stage's documents. All but the last return the
columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide.llm import bpe, forest, langid, mixing, suffix
from ventide.llm.tables import free_name, ready, settled, stored, table

#: A document of no language, or of one less certain than this, goes. Chance is 0.25 with four.
LEAST_SCORE = 0.3

#: No stage of this pipeline but mixing can be told in SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents and drop those whose language is not recognised."""
    ready(spark)
    columns = docs.columns
    found = langid.predict(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest key, once."""
    ready(spark)
    mark = free_name(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))

    def representatives() -> DataFrame:
        told = forest.classify(marked.select("doc_id", "text", mark), carry=(mark,)).where("kept")
        return told.groupBy("doc_id", mark).agg(F.count("*").alias("n"))

    told = settled(representatives, "kept")
    same = marked["doc_id"].eqNullSafe(told["doc_id"]) & (marked[mark] == told[mark])
    kept = marked.join(told.where("doc_id IS NULL OR n = 1"), same, "left_semi")
    again = told.where("doc_id IS NOT NULL AND n > 1")
    if not again.isEmpty():  # rows given several times: one of each
        same = (marked["doc_id"] == again["doc_id"]) & (marked[mark] == again[mark])
        kept = kept.unionByName(marked.join(again, same, "left_semi").dropDuplicates(["doc_id", mark]))
    return kept.drop(mark)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what repeats an earlier passage out of the texts, whole characters at a time."""
    ready(spark)
    cut = suffix.cut(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_bytes").cast("string"))
    return (
        cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
        .select(*docs.columns)
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    ready(spark)
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    ready(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), path, pattern, offsets=False, drop=("text",))
    return bpe.digests(bpe.decode(encoded, path, text=False), "source", "ids")


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("byte_level_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
