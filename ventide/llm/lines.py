"""Removing lines that many documents share, by keep bitmaps.

A line's key is the line without the white space at both ends and with A-Z lower-cased; it is
hashed to 128 bits. One row per line (hash, document, position) is range-partitioned and sorted by
hash, then document, then position. Each task streams its range once: a row that is the first of
its key in its document counts that document, and a key is told as soon as it is found in `least`
documents, so that no more than those rows wait. Ranges are cut by document and position as well as
by hash, so a line that a third of all documents hold is spread over many tasks. Only the first and
the last key of a range can go on in the next one: these are told by one small table of sums, at
most two rows a range.

What comes back to a document is not text but a compressed bitmap: bit i is 1 if line i stays; lines
past its end stay. A document that loses nothing has none.

Defined cases: a null or empty text is one empty line; keys of fewer than `least_chars` code points
always stay; each row of the table is a document of its own, so repeated rows count each; rows with
the same key and text get the same bitmap; rows without a key are documents too; an empty table
gives an empty result; clashing columns are replaced; memory follows the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm import arrays as A
from ventide.llm.tables import stored

LEAST, LEAST_CHARS = 10, 1
_NEWLINE = 10


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line begins and ends, and the text it is in."""
    breaks = np.flatnonzero(data == _NEWLINE)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    counts = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    return begins, ends, np.repeat(np.arange(len(counts)), counts)


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's key, and its code points."""
    solid = np.flatnonzero(~A.SPACE[data])
    first, last = np.searchsorted(solid, begins), np.searchsorted(solid, ends)
    some = last > first
    low, high = begins.copy(), begins.copy()
    low[some], high[some] = solid[first[some]], solid[last[some] - 1] + 1
    lower = A.lower_ascii(data)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    one, two = (A.ranges(A.prefix(lower, base), low, high, base).view(np.int64) for base in (A.BYTE_BASE, A.WORD_BASE))
    return one, two, leads[high] - leads[low]


def _keyed(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """One row per line that can be dropped: hash, document, position, first of its key there."""
    schema = T.StructType([
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc", docs.schema[key].dataType),
        T.StructField("mark", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("fresh", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in (x for b in batches for x in A.portions(iter([b]), "text")):
            begins, ends, of = split(data, offsets)
            one, two, chars = hashes(data, begins, ends)
            pos = A.runs(np.bincount(of, minlength=rows.num_rows))
            at = np.flatnonzero(chars >= least_chars)
            order = at[np.lexsort((pos[at], two[at], one[at], of[at]))]
            again = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
            fresh = np.ones(len(of), bool)
            fresh[order[1:][again]] = False
            which = pa.array(of[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[at]), pa.array(two[at]), rows.column(0).take(which), rows.column(1).take(which),
                 pa.array(pos[at].astype(np.int32)), pa.array(fresh[at])], names=schema.names)

    slim = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return slim.mapInArrow(run, schema)


class _Stream:
    """The keys of one sorted range, one after the other.

    Rows told to go carry their document and position. Rows of the range's first and last key that
    are not told yet carry the hash too (`head`: the key's first row here), and each of these keys
    has one row with the documents counted here.
    """

    def __init__(self, schema: pa.Schema, least: int, keep_first: bool):
        self.schema, self.least, self.keep_first = schema, least, keep_first
        self.part = TaskContext.get().partitionId()
        self.key: tuple[int, int] | None = None
        self.border = True  # the key that is open began the range
        self.out: list[pa.RecordBatch] = []

    def _row(self, rows: pa.RecordBatch, **more) -> None:
        n = rows.num_rows
        given = {"doc": rows.column("doc"), "mark": rows.column("mark"), "pos": rows.column("pos")} | more
        self.out.append(pa.RecordBatch.from_arrays(
            [given[f.name].cast(f.type) if f.name in given else pa.nulls(n, f.type) for f in self.schema], schema=self.schema))

    def _open(self, key: tuple[int, int]) -> None:
        self.key, self.count, self.told, self.held, self.begun = key, 0, False, [], False

    def _gone(self, rows: pa.RecordBatch) -> None:
        """These rows go; of a key kept once its first row stays, or waits if it may not be the first."""
        if self.keep_first and not self.begun:
            if self.border:
                self._wait(rows.slice(0, 1))
            rows = rows.slice(1)
        self.begun = True
        if rows.num_rows:
            self._row(rows)

    def _wait(self, rows: pa.RecordBatch) -> None:
        n = rows.num_rows
        head = np.zeros(n, bool)
        head[0] = not self.begun
        self.begun = True
        self._row(rows, h1=rows.column("h1"), h2=rows.column("h2"), head=pa.array(head),
                  part=pa.array(np.full(n, self.part)))

    def _add(self, rows: pa.RecordBatch, count: int) -> None:
        self.count += count
        if not self.told and self.count >= self.least:
            self.told = True
            for part in self.held:
                self._gone(part)
            self.held = []
        if self.told:
            self._gone(rows)
        else:
            self.held.append(rows)

    def _close(self, last: bool) -> None:
        if self.border or last:
            for part in self.held:
                self._wait(part)
            one, two = (pa.array([x], pa.int64()) for x in self.key)
            self.out.append(pa.RecordBatch.from_arrays(
                [{"h1": one, "h2": two, "part": pa.array([self.part]), "n": pa.array([self.count])}[f.name].cast(f.type)
                 if f.name in ("h1", "h2", "part", "n") else pa.nulls(1, f.type) for f in self.schema], schema=self.schema))
        self.border = False

    def feed(self, batch: pa.RecordBatch) -> None:
        one, two = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1])
        ends, counts = np.append(starts[1:], len(one)), np.add.reduceat(fresh.astype(np.int64), starts)
        self._run(batch, one, two, starts[0], ends[0], int(counts[0]))  # may go on from the batch before
        if len(starts) > 2:
            inner = slice(1, len(starts) - 1)
            gone = np.repeat(counts[inner] >= self.least, (ends - starts)[inner])
            if self.keep_first:
                gone[starts[inner] - starts[1]] = False
            if gone.any():
                self._row(batch.take(pa.array(np.flatnonzero(gone) + starts[1])))
        if len(starts) > 1:  # may go on in the next batch
            self._run(batch, one, two, starts[-1], ends[-1], int(counts[-1]))

    def _run(self, batch: pa.RecordBatch, one: np.ndarray, two: np.ndarray, low: int, high: int, count: int) -> None:
        key = (int(one[low]), int(two[low]))
        if key != self.key:
            if self.key is not None:
                self._close(False)
            self._open(key)
        self._add(batch.slice(low, high - low), count)

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self.out
        self.out = []

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            self._close(True)
        yield from self.flush()


def bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST,
            least_chars: int = LEAST_CHARS, keep_first: bool = False) -> DataFrame:
    """Documents that lose lines: doc, mark (hash of the text), n_dropped, keep_bitmap.

    A key in `least` documents or more loses all its lines, or with `keep_first` all but the first
    in the order of documents and positions.
    """
    lines = stored(_keyed(docs, key, text, least_chars), "lines")
    schema = T.StructType([*(lines.schema[c] for c in ("doc", "mark", "pos", "h1", "h2")), T.StructField("head", T.BooleanType()),
                           T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                kinds = {"h1": pa.int64(), "h2": pa.int64(), "head": pa.bool_(), "part": pa.int32(), "n": pa.int64()}
                state = _Stream(pa.schema([(c, kinds.get(c) or batch.schema.field(c).type) for c in schema.names]), least, keep_first)
            state.feed(batch)
            yield from state.flush()
        if state is not None:
            yield from state.finish()

    order = ("h1", "h2", "doc", "mark", "pos")
    told = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(stream, schema), "lines-told")
    # At most two rows a range: its first and its last key.
    sums = told.where("n IS NOT NULL").groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("home"))
    waiting = told.where("n IS NULL AND h1 IS NOT NULL").join(F.broadcast(sums), ["h1", "h2"]).where(F.col("total") >= least)
    if keep_first:
        waiting = waiting.where(~(F.col("head") & (F.col("part") == F.col("home"))))
    where = told.where("h1 IS NULL").select("doc", "mark", "pos").unionByName(waiting.select("doc", "mark", "pos"))
    places = where.groupBy("doc", "mark").agg(F.collect_set("pos").alias("places"))  # at most the text's lines
    shape = T.StructType([lines.schema["doc"], lines.schema["mark"], T.StructField("n_dropped", T.LongType()),
                          T.StructField("keep_bitmap", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("places")
            counts = column.value_lengths().to_numpy()
            out = []
            for at in np.split(np.asarray(column.flatten()), np.cumsum(counts)[:-1]) if len(counts) else []:
                keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
                keep[at] = False
                out.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("mark"), pa.array(counts.astype(np.int64)), pa.array(out, pa.binary())],
                names=shape.names)

    return places.mapInArrow(pack, shape)


def kept_lines(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of a document's n lines stays."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n].astype(bool)
        keep[:len(bits)] = bits
    return keep


def apply(docs: DataFrame, maps: DataFrame, *, key: str = "doc_id", text: str = "text", drop: Sequence[str] = ()
          ) -> DataFrame:
    """Adds n_lines, n_dropped, keep_bitmap and kept_text (the lines that stay, joined by \\n)."""
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
              T.StructField("keep_bitmap", T.BinaryType()), T.StructField("kept_text", T.StringType())]
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [c for c in docs.columns if c.lower() not in gone]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    left = docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(key).alias("own"), F.col(text).alias("text"),
                       F.xxhash64(text).alias("own_mark"))
    # Bitmaps grow with the input: the same join at every size, not a broadcast while they are few.
    joined = left.join(maps.hint("merge"), left["own"].eqNullSafe(maps["doc"]) & (left["own_mark"] == maps["mark"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in (x for b in batches for x in A.portions(iter([b]), "text")):
            begins, ends, of = split(data, offsets)
            counts = np.bincount(of, minlength=rows.num_rows)
            maps_here = rows.column(2)
            raw, out, low = data.tobytes(), [], 0
            for i, bitmap in enumerate(maps_here.to_pylist()):
                if bitmap is None:
                    out.append(raw[offsets[i]:offsets[i + 1]])
                else:
                    stays = np.flatnonzero(kept_lines(bitmap, int(counts[i]))) + low
                    out.append(b"\n".join([raw[a:b] for a, b in zip(begins[stays].tolist(), ends[stays].tolist())]))
                low += int(counts[i])
            row = rows.column(0)
            yield pa.RecordBatch.from_arrays(
                [*row.flatten(), pa.array(counts.astype(np.int64)), rows.column(3).fill_null(0), maps_here,
                 pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    return joined.select("row", "text", "keep_bitmap", "n_dropped").mapInArrow(run, schema)


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, least_chars: int = LEAST_CHARS,
          keep_first: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """The documents with n_lines, n_dropped, keep_bitmap and kept_text."""
    maps = bitmaps(docs, key=key, text=text, least=least, least_chars=least_chars, keep_first=keep_first)
    return apply(docs, stored(maps, "line-bitmaps"), key=key, text=text, drop=drop)


ORACLE = r"""
WITH parts AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents
), lines AS (
    SELECT r, doc_id, unnest(list) AS line, unnest(range(1, len(list) + 1)) AS pos FROM parts
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON k.key = o.key
GROUP BY r, doc_id
"""
