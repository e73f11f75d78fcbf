"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; a policy is a versioned set of bits, applied later without touching a text, and an
ablation is a count over the few distinct bit patterns.

Defined cases: a null or empty text has no words and measures 0 everywhere, so it fails `short`;
rows are independent, so repeated rows and null or repeated keys stay; an empty table gives an
empty ledger; clashing columns are replaced; a text is measured whole, in memory that follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm import arrays as A

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_bangs")

#: Rule, and when it fails, over the measurements. A rule keeps its bit for ever.
RULES = (
    ("short", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("lines", "100 * n_dup_lines > 30 * n_lines"),
    ("capitals", "100 * n_upper > 30 * word_chars"),
    ("shouts", "10 * n_bangs > n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 16 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["short"] | BIT["repeats"]

#: Versioned policies: which failures reject a document.
POLICIES = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["lines"] | BIT["word_length"],
    "v2": sum(BIT.values()),
}

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measurements of each text in one pass over its bytes."""
    n = len(offsets) - 1
    low, high = offsets[:-1], offsets[1:]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[high] - sums[low]

    starts, ends, before = A.words(data, offsets)
    count = np.diff(before)
    solid = ~A.SPACE[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    upper = ((data >= 65) & (data <= 90)) | (after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    sums = A.prefix(data, A.BYTE_BASE)

    # Lines: equal bytes within one text.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([low[low < high], breaks + 1]))
    begin = begin[begin < len(data)]
    text = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, begin)], high[text])
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, text = begin[worded], stop[worded], text[worded]
    line = A.mix(A.ranges(sums, begin, stop, A.BYTE_BASE) + (stop - begin).astype(A.U)) ^ A.mix(text.astype(A.U))
    _, first = np.unique(line, return_index=True)
    lines = np.bincount(text, minlength=n)

    # Windows of words that occur again in the same text.
    at, owner = A.window_ids(count, WINDOW)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        chain = A.prefix(A.ranges(sums, starts, ends, A.BYTE_BASE), A.WORD_BASE)
        window = A.ranges(chain, at, at + WINDOW, A.WORD_BASE) ^ A.mix(owner.astype(A.U))
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + WINDOW, -1)
    repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])

    return {
        "n_words": count,
        "word_chars": per_text(solid & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(SYMBOLS[data]),
        "n_dup_lines": lines - np.bincount(text[first], minlength=n),
        "n_repeat_words": repeated[before[1:]] - repeated[before[:-1]],
        "n_lines": lines,
        "n_upper": per_text(upper),
        "n_bangs": per_text(data == 33),
    }


def ledger(docs: DataFrame, *, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """The documents (without the columns in `drop`) with all measurements and `failed`, the
    failure bits."""
    gone = {*MEASURES, "failed", *(d.lower() for d in drop)}
    keep = [c for c in docs.columns if c.lower() not in gone]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.portions(batches, text):
            found = measure(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in keep),
                 *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], names=schema.names)

    bits = None
    for name, fails in RULES:
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return docs.mapInArrow(run, schema).withColumn("failed", bits)


def verdict(book: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with base_failed, the policy's name and kept."""
    mask = POLICIES[policy]
    return (
        book.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0)
        .withColumn("policy", F.lit(policy))
        .withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask)) == 0)
    )


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail nothing else, and that the
    policy would keep without it. The patterns of bits are counted first; there are few."""
    mask = POLICIES[policy]
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    seen = F.col("failed").bitwiseAND(F.lit(mask))
    structs = [
        F.struct(
            F.lit(name).alias("rule"),
            total(seen.bitwiseAND(F.lit(BIT[name])) != 0).alias("failed"),
            total(seen == BIT[name]).alias("failed_alone"),
            total(F.col("failed").bitwiseAND(F.lit(mask & ~BIT[name])) == 0).alias("kept_without"),
        )
        for name, _ in RULES if mask & BIT[name]
    ]
    return patterns.agg(F.array(*structs).alias("r")).select(F.inline("r"))


#: The measurements and the verdict in another engine's SQL.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tok AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, len(words) AS n FROM w),
win AS (
  SELECT doc_id, i, n, CASE WHEN i + 7 <= n THEN
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS s
  FROM tok),
rep AS (
  SELECT doc_id, i, s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 AS again FROM win),
cov AS (
  SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c
  FROM rep),
repeats AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM cov GROUP BY doc_id),
line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]')), 0)::BIGINT AS word_chars,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    coalesce(len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')), 0) AS n_upper,
    coalesce(len(regexp_extract_all(text, '!')), 0) AS n_bangs
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
       OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_upper > 30 * word_chars OR 10 * n_bangs > n_words
       OR word_chars < 2 * n_words OR word_chars > 16 * n_words) AS kept
FROM m
"""
