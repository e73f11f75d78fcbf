"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide.llm import (bpe, forest, langid, lines, mixing, pages, periods, rotation, rules, sharding, spelling, suffix,
                         toolcalls)
from ventide.llm.tables import ready, table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    spans = F.transform("removed", lambda r: (r["high"] - r["low"]).cast("long"))
    return suffix.cut(docs, drop=("text",)).select(
        "doc_id", "n_bytes", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op2_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(ready(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    calls, results = toolcalls.from_conversations(turns)
    rows = toolcalls.format_calls(calls, results, toolcalls.schema_table(spark))
    return rows.withColumn("errors", F.concat_ws(",", "errors"))


def op3_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.classify(table(ready(spark), sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


def op4_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ready(spark), sf_dir, "pages").select("page_id", "url", "html")
    found = pages.main_text(rows, pages.train(rows), drop=("html",))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(docs, path, pattern, offsets=False, drop=("text",))
    return bpe.digests(bpe.decode(tokens, path, text=False))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(ready(spark), sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), "null").otherwise(F.sha2("text", 256)).alias("digest"))
    placed = sharding.assign(rows, size="size", group=F.col("digest"), order=F.col("doc_id"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.classify(table(ready(spark), sf_dir, "documents").select("doc_id", "text"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    return rules.verdict(rules.ledger(docs, drop=("text",)), "v2").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model, drop=("text",))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents").select("doc_id", "text")
    kept = lines.dedup(docs, least=10, least_chars=1, drop=("text",))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def _id_text(key: str = "doc_id") -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def op12_gram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a missing letter wherever 97 divides the hash of document and word."""
    text = F.translate(F.coalesce("text", F.lit("")), spelling.UPPER, spelling.LOWER)
    runs = table(ready(spark), sf_dir, "documents").select(
        _id_text().alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    without = F.expr("concat(substr(run, 1, int(h % char_length(run))), substr(run, int(h % char_length(run)) + 2))")
    words = hashed.select(F.when(F.col("h") % 97 == 0, without).otherwise(F.col("run")).alias("word"))
    found = spelling.group(spelling.vocabulary(words, least_length=5, least_count=3), ratio=2)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in ten repeats a passage from some word on; every document's runs are found."""
    docs = table(ready(spark), sf_dir, "documents").select(
        "doc_id", F.col("text").alias("own"), F.crc32(_id_text().cast("binary")).alias("h"))
    tenth = docs.select("doc_id", "own", F.expr("h DIV 10").alias("g"), (F.col("h") % 10 == 0).alias("hit"))
    listed = tenth.withColumn(
        "words", F.when(F.col("hit"), F.regexp_extract_all(F.coalesce("own", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    placed = listed.withColumn("n", F.coalesce(F.size("words"), F.lit(0)).cast("long")).withColumn(
        "a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    again = F.expr("""array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(
        slice(words, int(a) + 1, int(p)), int((n - a + p - 1) DIV p))), 1, int(n - a))), ' ')""")
    texts = placed.select("doc_id", F.when(F.col("hit") & (F.col("n") > 0), again).otherwise(F.col("own")).alias("text"))
    found = periods.find(texts, least=24, cube=3, drop=("text",))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
        F.col("top.period").alias("period"), F.expr("(1000 * top.length) DIV top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(told, lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_toolcalls": op2_toolcalls,
    "op3_rotation_codes": op3_rotation_codes,
    "op4_page_tree": op4_page_tree,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_rules": op8_rules,
    "op9_langid": op9_langid,
    "op10_mixing": op10_mixing,
    "op11_line_bitmaps": op11_line_bitmaps,
    "op12_gram_index": op12_gram_index,
    "op13_periods": op13_periods,
}

ORACLES = {
    "op2_toolcalls": toolcalls.ORACLE,
    "op8_rules": rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_line_bitmaps": lines.ORACLE,
}
