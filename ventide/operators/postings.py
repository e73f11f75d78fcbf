"""Postings of wanted phrases, counted inside the row: no row per word or per run of words.

A task gets chunks as lists of tokens, reduces each batch to its distinct tokens, stems those once if asked
for, and looks only at runs of words that occur in some wanted phrase. What may be wanted is told by two bitmaps over
hashes; a false hit costs a row and is removed by the join with the phrases, so results do not depend on their
size. A chunk that repeats a phrase emits it once, with its weighted count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide.functions.stem import stem

#: A bitmap has at most 2**MOST_BITS bits (2 MB), however many phrases are wanted.
LEAST_BITS, MOST_BITS = 12, 24
BITS_A_PHRASE = 16


def stemmed(phrases: DataFrame, key: str = "key") -> DataFrame:
    """(key, phrase, n) with every word of the phrases replaced by its stem. Distinct phrases are stemmed once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([" ".join(map(stem, t.split(" "))) for t in texts], pa.string())], names=["phrase", "_stems"])

    known = phrases.select("phrase").distinct().mapInArrow(run, "phrase string, _stems string")
    return phrases.join(known, "phrase").select(key, F.col("_stems").alias("phrase"), "n").distinct()


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bits at the hashes of `column`, made by the tasks; the driver gets 64 bits a row, at most 2**18 rows."""
    wanted = max(1, values.count()) * BITS_A_PHRASE
    bits = min(MOST_BITS, max(LEAST_BITS, wanted.bit_length()))
    place = F.crc32(F.col(column)).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = values.select(F.shiftright(place, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    return words.view(np.uint64)


def _may_hold(words: np.ndarray, text: str) -> bool:
    place = zlib.crc32(text.encode()) & (len(words) * 64 - 1)
    return bool((int(words[place >> 6]) >> (place & 63)) & 1)


class _Reader:
    """Counts wanted runs of the token lists of one batch."""

    def __init__(self, words: np.ndarray, runs: np.ndarray, sizes: Sequence[int], stems: bool):
        self.words, self.runs, self.sizes, self.stems = words, runs, sizes, stems

    def count(self, lists: pa.ListArray, weight: int, into: list[Counter]) -> None:
        coded = lists.flatten().dictionary_encode()
        tokens = coded.dictionary.to_pylist()
        names = [stem(t) for t in tokens] if self.stems else tokens
        known = np.array([_may_hold(self.words, t) for t in names], bool)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        wanted = known[codes] if len(codes) else np.zeros(0, bool)
        reach = np.concatenate([[0], np.cumsum(wanted)])
        told: dict[str, bool] = {}
        for n in self.sizes:
            starts = np.arange(max(0, len(codes) - n + 1))
            full = (reach[n:] - reach[:-n] == n)[: len(starts)] if len(starts) else np.zeros(0, bool)
            starts = starts[full]
            starts = starts[starts + n <= ends[row[starts]]] if len(starts) else starts
            for at in starts.tolist():
                phrase = " ".join([names[c] for c in codes[at:at + n].tolist()])
                if phrase not in told:
                    told[phrase] = _may_hold(self.runs, phrase)
                if told[phrase]:
                    into[row[at]][phrase] += weight


def postings(chunks: DataFrame, wanted: DataFrame, sizes: Sequence[int], doc: str, title: Column, text: Column,
             title_weight: int, stems: bool = False) -> DataFrame:
    """(doc, _len, phrase, f): each wanted phrase a chunk holds, its occurrences in the title weighted.

    A chunk without a text (null) has no postings; a null title is an empty one. `wanted` has phrase and n.
    """
    sizes = sorted(sizes)
    base = chunks.select(doc, F.coalesce(title, F.array().cast("array<string>")).alias("_t"), text.alias("_b")).where("_b IS NOT NULL")
    if not sizes:
        return chunks.sparkSession.createDataFrame([], f"{doc} {dict(chunks.dtypes)[doc]}, _len int, phrase string, f long")
    phrase = wanted.select("phrase").distinct()
    word = phrase.select(F.explode(F.split("phrase", " ")).alias("w")).distinct()
    shared = chunks.sparkSession.sparkContext.broadcast((_bitmap(word, "w"), _bitmap(phrase, "phrase")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(*shared.value, sizes, stems)
        for batch in batches:
            found = [Counter() for _ in range(batch.num_rows)]
            reader.count(batch.column("_t"), title_weight, found)
            reader.count(batch.column("_b"), 1, found)
            sums = [len(c) for c in found]
            if not sum(sums):
                continue
            at = pa.array(np.repeat(np.arange(batch.num_rows), sums))
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc).take(at), batch.column("_len").take(at), pa.array([p for c in found for p in c], pa.string()),
                 pa.array([n for c in found for n in c.values()], pa.int64())], names=[doc, "_len", "phrase", "f"])

    shape = f"{doc} {dict(chunks.dtypes)[doc]}, _len int, phrase string, f long"
    counted = base.select(doc, (F.size("_t") + F.size("_b")).alias("_len"), "_t", "_b").mapInArrow(run, shape)
    return counted.join(phrase, "phrase", "left_semi")
