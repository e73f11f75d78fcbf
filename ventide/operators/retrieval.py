"""Lexical, dense and fused ranking of chunks, and the map from keys to passages."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.textfn import anchor_hits
from ventide.operators.postings import postings, stemmed
from ventide.session import materialize

K1, B = 1.2, 0.75
TITLE_WEIGHT = 2
# Queries whose vectors are shipped to the tasks at once.
BLOCK_QUERIES = 4096


def enumerate_keys() -> list[dict]:
    """Every key the explanation layer can ask for: one context per parameter and kind, one
    action list per band and parameter."""
    keys = []
    for p, (label, unit, _) in C.PARAM_DISPLAY.items():
        terms = C.PARAM_TERMS[p]
        keys.append({"key": f"context:{p}", "channel": "context", "label": label,
                     "terms": list(terms), "query": " ".join((label, unit, *terms))})
    for kind, terms in C.KIND_TERMS.items():
        keys.append({"key": f"context:kind:{kind}", "channel": "context", "label": kind,
                     "terms": list(terms), "query": " ".join(terms)})
    for band, p in itertools.product(C.BAND_NAMES, C.PARAM_DISPLAY):
        terms = C.PARAM_TERMS[p]
        keys.append({"key": f"action:{band}:{p}", "channel": "actions",
                     "label": C.PARAM_DISPLAY[p][0], "terms": list(terms),
                     "query": " ".join((*terms, *C.BAND_TERMS[band]))})
    return keys


def key_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        enumerate_keys(),
        "key string, channel string, label string, terms array<string>, query string")


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def phrases(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, phrase, n): every anchor term and every query word, as token phrases, once."""
    both = F.concat("terms", F.split("query", r"\s+"))
    phrase = F.transform(both, lambda t: F.array_join(index_tokens(t), " "))
    distinct = F.explode(F.array_distinct(F.filter(phrase, lambda p: p != "")))
    return keys.select(key, distinct.alias("phrase")).withColumn(
        "n", F.size(F.split("phrase", " ")))


def phrase_lengths(table: DataFrame) -> list[int]:
    return sorted(r["n"] for r in table.select("n").distinct().collect())


def _runs(items: Column, n: int) -> Column:
    last = F.size(items) - n + 1
    return F.when(last >= 1, F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(items, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def bm25(chunks: DataFrame, wanted: DataFrame, key: str = "key", doc: str = "chunk_id",
         top: int = C.RANK_TOP_N, stems: bool = False) -> DataFrame:
    """Top chunks per key by BM25 over title (double weight) and text.

    Postings are the chunk's phrases that occur in some key, counted inside the row, so a
    phrase emits one posting per chunk however often it repeats. With `stems`, words agree when their
    stems do. Ranks are cut to the top before the shuffle.
    """
    if stems:
        wanted = materialize(stemmed(wanted, key))
    title, body = index_tokens(F.col("title")), index_tokens(F.col("text"))
    length = F.coalesce(F.size(title), F.lit(0)) + F.when(F.col("text").isNotNull(), F.size(body))
    stats = chunks.select(length.alias("_len")).agg(F.count(F.lit(1)).alias("n"), F.avg("_len").alias("avg"))
    found = materialize(postings(chunks, wanted, phrase_lengths(wanted), doc, title, body, TITLE_WEIGHT, stems))
    frequency = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    total = stats.select("n").scalar()
    average = stats.select("avg").scalar()
    idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = F.col("f") + K1 * (1 - B + B * F.col("_len") / average)
    scored = (
        found.join(frequency, "phrase").join(wanted.select(key, "phrase"), "phrase")
        .groupBy(key, doc).agg(F.round(F.sum(idf * F.col("f") * (K1 + 1) / norm), 9).alias("score"))
    )
    return top_ranked(scored, key, doc, top)


def top_ranked(scored: DataFrame, key: str, doc: str, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), doc))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def dense_topk(docs: DataFrame, queries: DataFrame, key: str, doc: str, vector: str = "embedding",
               top: int = C.RANK_TOP_N) -> DataFrame:
    """Top documents per query by cosine similarity.

    Queries are dealt into blocks of at most about BLOCK_QUERIES, by a hash of their key. A block's
    matrix is shipped to the tasks; every task keeps its own best few per query while it
    streams its rows, so the shuffle carries only candidates.
    """
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))
    parts = [_block_topk(docs, queries.where(block == b), key, doc, vector, top) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return top_ranked(found, key, doc, top)


def _block_topk(docs: DataFrame, queries: DataFrame, key: str, doc: str, vector: str, top: int) -> DataFrame:
    """Each task's best documents per query of one block."""
    rows = sorted(queries.select(key, vector).collect(), key=lambda r: r[key])
    key_type, doc_type = queries.schema[key].dataType, docs.schema[doc].dataType
    shape = f"{key} {key_type.simpleString()}, {doc} {doc_type.simpleString()}, score double"
    if not rows:
        return docs.sparkSession.createDataFrame([], shape)
    matrix = np.array([r[vector] for r in rows], dtype=np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    names = [r[key] for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, q = shared.value
        kept = pd.DataFrame({key: [], doc: [], "score": []})
        for batch in batches:
            if batch.empty:
                continue
            d = np.vstack(batch[vector].to_numpy()).astype(np.float64)
            d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)
            sims = np.round(d @ q.T, 9)
            ids = batch[doc].to_numpy()
            parts = []
            for j, name in enumerate(labels):
                order = np.lexsort((ids, -sims[:, j]))[:top]
                parts.append(pd.DataFrame({key: name, doc: ids[order], "score": sims[order, j]}))
            kept = pd.concat([kept, *parts]) if len(kept) else pd.concat(parts)
            kept = kept.sort_values([key, "score", doc], ascending=[True, False, True])
            kept = kept.groupby(key).head(top)
        if len(kept):
            yield kept

    return docs.select(doc, vector).mapInPandas(best, shape)


def fuse(channels: dict[str, DataFrame], key: str, doc: str) -> DataFrame:
    """Reciprocal rank fusion over whichever channels ranked a document. Ranks have no units."""
    merged = None
    for name, ranked in channels.items():
        part = ranked.select(key, doc, F.lit(name).alias("channel"), "rank")
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy(key, doc).agg(
        F.round(F.sum(1.0 / (C.RRF_K + F.col("rank"))), 5).alias("score"),
        F.count(F.lit(1)).alias("channels"))


def _rerank(ranked: DataFrame, key: str, doc: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy("rank", doc)
    return ranked.withColumn("rank", F.row_number().over(order))


def evidence_map(chunks: DataFrame, keys: DataFrame, channels: dict[str, DataFrame],
                 rerank=None) -> DataFrame:
    """Passages per key: admissible ones only, fused, best kind first, cut to the key's share.

    A passage must mention an anchor term; actions come from recommendations only. `rerank`
    maps admissible candidates (key, query, chunk_id, title, text) to one more ranked channel.
    """
    candidates = None
    for ranked in channels.values():
        part = ranked.select("key", "chunk_id")
        candidates = part if candidates is None else candidates.unionByName(part)
    pairs = candidates.distinct().join(keys, "key").join(chunks, "chunk_id")
    hits = anchor_hits(F.concat_ws(" ", "title", "text"), F.col("terms"))
    allowed = pairs.withColumn("anchor_hits", hits).where(
        (F.col("anchor_hits") > 0)
        & ((F.col("channel") != "actions") | (F.col("kind") == "recommendation")))
    pool = allowed.select("key", "chunk_id")
    admitted = {
        name: _rerank(ranked.join(pool, ["key", "chunk_id"], "left_semi"), "key", "chunk_id")
        for name, ranked in channels.items()
    }
    if rerank is not None:
        admitted["cross"] = rerank(allowed.select("key", "query", "chunk_id", "title", "text"))
    fused = fuse(admitted, "key", "chunk_id")
    priority = F.array_position(F.array(*[F.lit(k) for k in C.KIND_PRIORITY]), F.col("kind"))
    order = Window.partitionBy("key").orderBy(
        F.when(priority > 0, priority).otherwise(99), F.col("score").desc(), "chunk_id")
    share = F.when(F.col("channel") == "actions", C.EVIDENCE_ACTIONS_K).otherwise(
        C.EVIDENCE_CONTEXT_K)
    return (
        allowed.join(fused, ["key", "chunk_id"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(C.EVIDENCE_ACTIONS_K, C.EVIDENCE_CONTEXT_K))
        .where(F.col("rank") <= share)
        .select("key", "channel", "rank", "chunk_id", "kind", "citation", "text", "score",
                "anchor_hits",
                F.when(F.col("anchor_hits") < C.EVIDENCE_MIN_ANCHORS, "weak_match").alias("flag"))
    )


def key_status(keys: DataFrame, passages: DataFrame) -> DataFrame:
    """missing without passages, weak when all are flagged, ok otherwise."""
    counted = passages.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count("flag").alias("weak"))
    return keys.select("key", "channel").join(counted, "key", "left").select(
        "key", "channel", F.coalesce("n", F.lit(0)).alias("passages"),
        F.when(F.col("n").isNull(), "missing").when(F.col("n") == F.col("weak"), "weak")
        .otherwise("ok").alias("status"))
