"""Grouping spelling variants: words that one insertion, deletion or replacement apart, found with
grams of variable length.

1. Gram dictionary. Grams of 2 to LONGEST code points of all words (framed by a mark at both ends)
   are counted; a gram is lengthened where it is frequent and ends where it is not. What is kept of
   the dictionary is its inner part, the frequent grams. Frequent means more than FREQUENT words and
   more than the share that lets MOST grams in, so the dictionary has a proven size.
2. Decomposition. At each place of a word stands the shortest gram that is not frequent (or the
   longest, or one that ends with the word). A gram depends on its own code points alone.
3. Bound. One edit changes the grams that hold the edited place: per word the most grams over any
   place, `affected`. Two near words share all grams but those, so each holds a shared gram among its
   `affected` + 1 rarest ones; longer lists are never merged. Every word of LONGEST code points or
   more has more grams than an edit can affect.
4. List merging. One edit lies before a shared gram or after it. So the word agrees from its begin to
   the gram's end, or from the gram to its end, with a word as long or one longer. Lists are keyed by
   that part and the length, which keeps lists of frequent grams apart, and merged by a join.
5. Verification by edit distance, in the same join, then one row per pair.

A word's form is its near word of largest count; a root follows forms to the last one. Counts at
least double on the way, so jumping over jumps ends after a few rounds.

Defined cases: null words, and words shorter than LONGEST or with fewer than `least_count`
occurrences, are left out; repeated words are counted together; ties go to the smaller word in
code-point order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm.tables import stored

SHORTEST, LONGEST = 2, 5  # code points of a gram
FREQUENT, MOST = 32, 100_000
BUCKETS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(words: DataFrame, *, word: str = "word", least_length: int = LONGEST, least_count: int = 3) -> DataFrame:
    """Distinct words with their occurrences n."""
    if least_length < LONGEST:
        raise ValueError(f"words need {LONGEST} code points, or one edit may change all their grams")
    counted = words.where(F.char_length(word) >= least_length).groupBy(F.col(word).alias("word"))
    return counted.agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _framed(word: str) -> str:
    return f"\x02{word}\x03"


def decompose(word: str, frequent: set[str] | frozenset[str]) -> list[str]:
    """The gram at each place of the framed word."""
    s, out = _framed(word), []
    for at in range(len(s) - SHORTEST + 1):
        end = at + SHORTEST
        while end < len(s) and end - at < LONGEST and s[at:end] in frequent:
            end += 1
        out.append(s[at:end])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit can change: those over one place."""
    change = np.zeros(len(grams) + LONGEST + 1, np.int64)
    at = np.arange(len(grams))
    np.add.at(change, at, 1)
    np.add.at(change, at + np.array([len(g) for g in grams]), -1)
    return int(np.cumsum(change).max())


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def dictionary(words: DataFrame, most: int = MOST) -> tuple[frozenset[str], np.ndarray]:
    """The frequent grams, fewer than `most`, and how many grams fall in each bucket of a hash."""
    framed = words.select(F.concat(F.lit("\x02"), "word", F.lit("\x03")).alias("s")).withColumn("size", F.char_length("s"))
    places = framed.select("s", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at"))
    sized = places.select("s", "size", "at", F.explode(F.array(*map(F.lit, range(SHORTEST, LONGEST + 1)))).alias("long"))
    grams = stored(
        sized.where(F.col("at") + F.col("long") <= F.col("size") + 1)
        .groupBy(F.substring("s", F.col("at"), F.col("long")).alias("gram")).agg(F.count("*").alias("n")), "grams")
    short = grams.where(F.char_length("gram") < LONGEST)
    total = short.agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT, math.ceil(total / most))  # fewer than `most` grams can be above it
    frequent = frozenset(r[0] for r in short.where(F.col("n") > least).select("gram").collect())
    counts = np.zeros(BUCKETS, np.int64)
    bucket = F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(BUCKETS))
    for b, n in grams.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        counts[b] = n
    return frequent, counts


def rarest(word: str, frequent: frozenset[str], counts: np.ndarray) -> list[tuple[int, str]]:
    """The grams of a word, with their places, that a near word must share one of."""
    grams = decompose(word, frequent)
    keyed = sorted((int(counts[_bucket(g)]), g, at) for at, g in enumerate(grams))
    return [(at, g) for _, g, at in keyed[:affected(grams) + 1]]


def _lists(words: DataFrame, frequent: frozenset[str], counts: np.ndarray) -> DataFrame:
    """word, n, side and part: what agrees with a near word if the edit is after (0) or before (1)
    one of the word's rarest grams."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("side", T.IntegerType()), T.StructField("part", T.StringType())])
    shared = words.sparkSession.sparkContext.broadcast((frequent, counts))  # MOST short grams, BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                s = _framed(word)
                parts = set()
                for at, gram in rarest(word, frequent, counts):
                    parts |= {(0, s[:at + len(gram)]), (1, s[at:])}
                for side, part in sorted(parts):
                    for column, value in zip(out, (word, n, side, part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.string())], names=schema.names)

    return words.select("word", "n").mapInArrow(run, schema)


def links(words: DataFrame) -> DataFrame:
    """Pairs of words one edit apart, each once: a, a_n, b, b_n (b is longer, or as long and larger)."""
    lists = stored(_lists(words, *dictionary(words)).withColumn("size", F.char_length("word")), "gram-lists")
    probes = lists.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), "side", "part",
        F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("size").alias("a_size"))
    index = lists.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "side", "part", "size")
    met = probes.join(index, ["side", "part", "size"]).where(
        ((F.col("size") > F.col("a_size")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def group(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of a vocabulary (word, n)."""
    words = stored(words.select("word", "n"), "words")
    pairs = stored(links(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    near = both.groupBy("a", "a_n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    led = -F.col("best.less") >= ratio * F.col("a_n")
    near = stored(near.select(F.col("a").alias("near_word"), "n_near", F.when(led, F.col("best.b")).alias("form"),
                              F.when(led, -F.col("best.less")).alias("form_n")), "forms")
    up = near.where("form IS NOT NULL").select(F.col("near_word").alias("low"), F.col("form").alias("up"), F.lit(True).alias("open"))
    while True:  # each round doubles the steps that `up` has gone
        above = up.select(F.col("low").alias("up"), F.col("up").alias("higher"))
        up = stored(up.join(above, "up", "left").select(
            "low", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("open")), "roots")
        if up.where("open").isEmpty():
            break
    found = words.join(near, words["word"] == near["near_word"], "left").join(up, words["word"] == up["low"], "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n",
                        F.coalesce("up", "word").alias("root"))
