"""Removing later copies of long byte strings with longest-previous-factor arrays.

A byte goes if some string of LENGTH bytes that covers it also starts earlier: in a smaller key, or
earlier in the same text. In a suffix array, the earlier suffix that shares most with a given one is
the nearest before or after it in suffix order whose position is smaller; the longer of the two
common prefixes is the longest previous factor, and a start is a repeat if that reaches LENGTH.

The suffixes of a corpus do not fit one array, so they are dealt into arrays that need each other's
entries nowhere. Every window of LENGTH bytes has an anchor, the window's smallest hash of GRAM
bytes. Equal windows have equal anchors at equal places; the windows of one anchor form a block.

1. Anchors that occur once are dropped: nothing repeats there.
2. Of equal blocks only the first can hold anything new; the others are repeats as a whole.
3. First blocks that share an anchor with different blocks go to one suffix array per anchor, which
   gives the longest previous factors of their windows.
4. An anchor with more than BUCKET different blocks is too hot for one array: its windows are keyed
   by their own hash, and the smallest position of each is the first. That needs no sorting and
   spreads over all tasks.

Rows that leave a task carry hashes and positions; text moves only with first blocks and once with
each document.

Defined cases: a null text is empty; texts shorter than LENGTH stay as they are; rows without a key
come last; rows with the same key and text are one document and get the same result, those with the
same key and other texts are ordered by the text's hash; an empty table gives an empty result;
clashing columns are replaced; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm import arrays as A
from ventide.llm.tables import free_name, settled, stored

LENGTH, GRAM, BUCKET = 100, 32, 1000
SEGMENT = 1 << 22  # window starts that are hashed at once
_INDEX = (1 << 24) - 1


def blocks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM
           ) -> tuple[np.ndarray, ...]:
    """Blocks of windows with one anchor: text, start, number of windows, hash of the anchor and of
    the block (bytes and place of the anchor in it). Starts are relative to the text."""
    out = []
    for low in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[low:low + SEGMENT + length - 1]
        sums = A.prefix(part, A.BYTE_BASE)
        at = np.arange(len(part) - gram + 1)
        hashes = A.ranges(sums, at, at + gram, A.BYTE_BASE)
        least, width, grams = (hashes & ~A.U(_INDEX)) | at.astype(A.U), 1, length - gram + 1
        while width * 2 <= grams:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < grams:
            least = np.minimum(least[:len(least) - (grams - width)], least[grams - width:])
        anchor = (least & A.U(_INDEX)).astype(np.int64)
        text = np.searchsorted(offsets, low + np.arange(len(anchor)), side="right") - 1
        start = np.flatnonzero(low + np.arange(len(anchor)) + length <= offsets[text + 1])
        if not len(start):
            continue
        of, text = anchor[start], text[start]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (text[1:] != text[:-1])]))
        last = np.append(new[1:], len(start)) - 1
        lo, hi, q = start[new], start[last], of[new]
        whole = A.ranges(sums, lo, hi + length, A.BYTE_BASE) + A.mix((q - lo).astype(A.U))
        out.append((text[new], low + lo - offsets[text[new]], hi - lo + 1, hashes[q], whole))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(A.U), none.astype(A.U)
    return tuple(np.concatenate(x) for x in zip(*out))


def previous_factors(data: np.ndarray, base: np.ndarray, starts: np.ndarray, group: np.ndarray,
                     length: int = LENGTH) -> np.ndarray:
    """Longest previous factors, at most `length`, of the suffixes at `starts` (ascending).

    Groups are arrays of their own. `base` tells the group of each byte of `data`; every suffix has
    `length` bytes of its own block.
    """
    def numbered(*keys: np.ndarray) -> np.ndarray:
        key = keys[0]
        for other in keys[1:]:
            key = key * (int(other.max(initial=0)) + 1) + other
        return np.unique(key, return_inverse=True)[1]

    # Ranks of ever longer prefixes: 1, 2, 4, ... bytes, at last `length`.
    rank, width = numbered(base, data.astype(np.int64)), 1
    while width * 2 <= length:
        rank = numbered(rank[:-width], rank[width:])
        width *= 2
    if width < length:
        rank = numbered(rank[:len(rank) - (length - width)], rank[length - width:])
    order = np.argsort(rank[starts], kind="stable")  # suffix order; equal ones by position
    place = starts[order]
    n = len(place)

    # Common prefixes of neighbours in suffix order, by bisection over hashes.
    sums = A.prefix(data, A.BYTE_BASE)
    low, high = np.zeros(n - 1, np.int64), np.full(n - 1, length)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = (A.ranges(sums, place[:-1], place[:-1] + middle, A.BYTE_BASE)
                == A.ranges(sums, place[1:], place[1:] + middle, A.BYTE_BASE))
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    common = np.where(group[order[:-1]] == group[order[1:]], low, 0)

    def nearest_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Common prefix with the nearest earlier entry whose position is smaller, by jumping: what
        lies between an entry and its candidate is larger than both."""
        at = np.arange(len(position)) - 1
        reach = np.concatenate([[0], shared])
        while True:
            jump = (at >= 0) & (position[np.maximum(at, 0)] > position)
            if not jump.any():
                return np.where(at >= 0, reach, 0)
            reach[jump] = np.minimum(reach[jump], reach[at[jump]])
            at[jump] = at[at[jump]]

    before = nearest_smaller(place, common)
    after = nearest_smaller(place[::-1], common[::-1])[::-1]
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _column(rows: pa.RecordBatch, name: str):
    return rows.column(rows.schema.get_field_index(name))


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in A.portions(batches, "_text"):
            yield pa.RecordBatch.from_arrays([_signed(blocks(data, offsets)[3])], names=["anchor"])

    return docs.select("_text").mapInArrow(run, "anchor long")


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.portions(batches, "_text"):
            text, start, windows, anchor, whole = blocks(data, offsets)
            key, copy = (np.asarray(_column(rows, c))[text] for c in ("_key", "_copy"))
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor), _signed(whole), pa.array(key), pa.array(copy), pa.array(start.astype(np.int32)),
                 pa.array(windows.astype(np.int32))], names=["anchor", "block", "_key", "_copy", "start", "windows"])

    return docs.select("_key", "_copy", "_text").mapInArrow(
        run, "anchor long, block long, _key long, _copy long, start int, windows int")


_OPEN = "hot boolean, a long, b long, _key long, _copy long, start int, windows int, content binary"


def _contents(rows: DataFrame) -> DataFrame:
    """Of each first block its bytes; of hot ones each window's two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in A.portions(batches, "_text"):
            keys, copies = (_column(part, c).to_pylist() for c in ("_key", "_copy"))
            cold, hot = [], []
            for i, found in enumerate(_column(part, "blocks").to_pylist()):
                text = data[offsets[i]:offsets[i + 1]]
                fiery = [f for f in found if f["hot"]]
                for f in found:
                    if not f["hot"]:
                        end = f["start"] + f["windows"] + LENGTH - 1
                        cold.append((False, f["anchor"], 0, keys[i], copies[i], f["start"], f["windows"],
                                     text[f["start"]:end].tobytes()))
                if fiery:
                    count = np.array([f["windows"] for f in fiery])
                    at = np.repeat([f["start"] for f in fiery], count) + A.runs(count)
                    x, y = (A.ranges(A.prefix(text, b), at, at + LENGTH, b).view(np.int64)
                            for b in (A.BYTE_BASE, A.WORD_BASE))
                    hot.append((x, y, np.full(len(at), keys[i]), np.full(len(at), copies[i]), at))
            names = [f.split()[0] for f in _OPEN.split(", ")]
            if cold:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*cold), (pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.int32(),
                                                                 pa.binary()))], names=names)
            if hot:
                x, y, key, copy, at = (np.concatenate(c) for c in zip(*hot))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(x), bool)), *(pa.array(v) for v in (x, y, key, copy)),
                     pa.array(at.astype(np.int32)), pa.array(np.ones(len(x), np.int32)),
                     pa.nulls(len(x), pa.binary())], names=names)

    return rows.mapInArrow(run, _OPEN)


def _whole_groups(batches: Iterator[pa.RecordBatch], name: str, most: int = 4000) -> Iterator[pa.RecordBatch]:
    """Runs of about `most` rows of a sorted stream that end where the named column changes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        values = np.asarray(_column(table, name))
        change = np.flatnonzero(values[1:] != values[:-1]) + 1
        low = 0
        for cut in [*change[np.searchsorted(change, np.arange(most, len(values), most), side="right") - 1]] \
                if len(change) else []:
            if cut > low:
                yield table.slice(low, cut - low)
                low = cut
        if len(change) and change[-1] > low:
            yield table.slice(low, change[-1] - low)
            low = int(change[-1])
        held, count = [table.slice(low)], len(values) - low
    if count:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays of sorted blocks, one per anchor; gives the runs of repeats."""
    for rows in _whole_groups(batches, "a"):
        place = [np.asarray(_column(rows, c)) for c in ("a", "_key", "_copy", "start")]
        fresh = np.ones(rows.num_rows, bool)  # repeated rows bring their blocks twice
        fresh[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in place])
        rows = rows.filter(pa.array(fresh))
        windows = np.asarray(_column(rows, "windows")).astype(np.int64)
        content = _column(rows, "content").to_pylist()
        sizes = np.array([len(c) for c in content])
        data = np.frombuffer(b"".join(content), np.uint8)
        anchor = np.asarray(_column(rows, "a"))
        group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        block = np.repeat(np.arange(len(windows)), windows)
        within = A.runs(windows)
        starts = (np.cumsum(sizes) - sizes)[block] + within
        again = previous_factors(data, np.repeat(group, sizes), starts, group[block]) >= LENGTH
        edge = np.flatnonzero(again & np.concatenate([[True], ~again[:-1] | (within[1:] == 0)]))
        stop = np.flatnonzero(again & np.concatenate([~again[1:] | (within[1:] == 0), [True]]))
        key, copy, start = (np.asarray(_column(rows, c))[block[edge]] for c in ("_key", "_copy", "start"))
        low = start + within[edge]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(copy), pa.array(low.astype(np.int32)),
             pa.array((low + within[stop] - within[edge] + LENGTH).astype(np.int32))],
            names=["_key", "_copy", "low", "high"])


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The documents with _key, _copy and _text; together key and copy name a text."""
    value = F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))
    again = stored(docs.groupBy(value.alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"),
                   "repeated-keys")
    return (
        docs.withColumn("_key", value).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .join(again, F.col("_key") == F.col("_again"), "left")
        .withColumn("_copy", F.when(F.col("_again").isNotNull(), F.xxhash64("_text")).otherwise(F.lit(0)).cast("long"))
        .drop("_again")
    )


def repeats(named: DataFrame) -> DataFrame:
    """_key, _copy and `spans`, a list of (low, high) that may touch or overlap, of all documents
    with something to remove."""
    anchors = _anchors(named).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    anchors = stored(anchors, "anchors")
    suspects = stored(_blocks(named).join(anchors, "anchor", "left_semi"), "suspects")
    firsts = stored(
        suspects.groupBy("anchor", "block")
        .agg(F.min(F.struct("_key", "_copy", "start", "windows")).alias("x"))
        .select("anchor", "block", F.col("x._key").alias("k"), F.col("x._copy").alias("c"),
                F.col("x.start").alias("s"), F.col("x.windows").alias("w")), "first-blocks")
    copies = (
        suspects.join(firsts, ["anchor", "block"])
        .where("_key <> k OR _copy <> c OR start <> s")
        .select("_key", "_copy", F.col("start").alias("low"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("high"))
    )
    shared = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    lists = (
        firsts.join(shared, "anchor")
        .groupBy(F.col("k").alias("_key"), F.col("c").alias("_copy"))
        .agg(F.collect_list(F.struct("anchor", F.col("s").alias("start"), F.col("w").alias("windows"),
                                     (F.col("n") > BUCKET).alias("hot"))).alias("blocks"))
    )
    opened = stored(_contents(named.select("_key", "_copy", "_text").join(lists, ["_key", "_copy"])), "open-blocks")
    cold = opened.where("not hot").repartition("a").sortWithinPartitions("a", "_key", "_copy", "start")
    found = cold.mapInArrow(_arrays, "_key long, _copy long, low int, high int")
    windows = opened.where("hot")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("_key", "_copy", "start")).alias("f"), F.count("*").alias("n"))
    later = (
        windows.join(first.where("n > 1").select("a", "b", "f"), ["a", "b"])
        .where("_key <> f._key OR _copy <> f._copy OR start <> f.start")
        .select("_key", "_copy", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
    )
    runs = copies.unionByName(found).unionByName(later)
    return runs.groupBy("_key", "_copy").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that touch or overlap."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def characters(raw: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """The part of a span that holds whole UTF-8 characters."""
    while low < high and raw[low] & 0xC0 == 0x80:
        low += 1
    while low < high < len(raw) and raw[high] & 0xC0 == 0x80:
        high -= 1
    return low, high


def cut(docs: DataFrame, *, key: str = "doc_id", text: str = "text", drop: tuple[str, ...] = (),
        whole_characters: bool = False) -> DataFrame:
    """The documents (without the columns in `drop`) with n_bytes, removed (maximal runs as low and
    high bytes) and kept_bytes. With `whole_characters` a run that begins or ends within a character
    leaves that character in place, so that what is kept stays UTF-8."""
    gone = {"n_bytes", "removed", "kept_bytes", *(d.lower() for d in drop)}
    inner = {c: free_name(docs, f"x{i}_") for i, c in enumerate(docs.columns) if c in ("_key", "_copy", "_text", "spans")}
    named = _named(docs.withColumnsRenamed(inner), inner.get(key, key), inner.get(text, text))
    keep = [inner.get(c, c) for c in docs.columns if c.lower() not in gone]
    spans = settled(lambda: repeats(named), "spans")
    needed = [*dict.fromkeys([*keep, "_key", "_copy", "_text"])]
    source = named.select(*needed).join(spans, ["_key", "_copy"], "left")
    span = T.ArrayType(T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())]))
    schema = T.StructType([*(named.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", span), T.StructField("kept_bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.portions(batches, "_text"):
            removed, kept = [], []
            for i, found in enumerate(_column(rows, "spans").to_pylist()):
                raw = data[offsets[i]:offsets[i + 1]]
                out = joined_spans([(f["low"], f["high"]) for f in found or ()])
                if whole_characters:
                    out = [s for s in (characters(raw, *s) for s in out) if s[0] < s[1]]
                stay = np.ones(len(raw), bool)
                for low, high in out:
                    stay[low:high] = False
                removed.append([{"low": a, "high": b} for a, b in out])
                kept.append(raw[stay].tobytes())
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(_column(rows, c) for c in keep), pa.array(np.diff(offsets)), pa.array(removed, kind),
                 pa.array(kept, pa.binary())], names=schema.names)

    back = {v: k for k, v in inner.items()}
    return source.mapInArrow(run, schema).withColumnsRenamed(back)
