"""Runs: stretches of words that repeat with a period, found with suffix trees.

A run is a stretch with smallest period q that no neighbouring word extends keeping that period.
By the runs theorem every run holds a longest Lyndon word of length q, for the usual or for the
reversed order of words. So each position gives at most two candidates: the longest Lyndon words
that start there end at the next smaller suffix in either order. Each candidate is extended to the
right by the longest common extension of its two ends, and to the left by that of the reversed words.

Extensions come from Ukkonen's suffix trees of the words and of the reversed words. One walk gives
the leaves in suffix order and, between two leaves that follow each other, the least string depth
of the Euler tour there; the depth of any two leaves' lowest common ancestor is a range minimum of
these, read in constant time from a sparse table.

A run of at least LEAST words and CUBE periods holds every window of 8 of its words again at a
distance of q. Stretches covered by windows that come back within the document, near enough for
their length, are therefore cut out first, by hashes over a whole Arrow batch; trees are built for
these stretches alone. A stretch has whole runs only, and a document without one costs no tree.

Defined cases: a null or empty text, or one without words, has no words and no runs; rows are
independent, so repeated rows and keys stay as they are; an empty table gives an empty result;
clashing columns are replaced; memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ventide.llm import arrays as A

LEAST, CUBE = 24, 3
#: A run of LEAST words and CUBE periods at least shows windows up to 9 words twice.
WINDOW = 8


class SuffixTree:
    """Ukkonen's tree of word numbers (0 and up), ended by a mark that is smaller than all.

    `rank` numbers the suffixes in order, `reversed_rank` in the order of reversed word numbers (the
    end stays the smallest); `common(i, j)` is the longest common prefix of suffixes.
    """

    def __init__(self, ids: list[int]):
        s = [x + 1 for x in ids] + [0]
        n, width = len(s), max(s) + 1
        begin, end, link, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting, fork = waiting + 1, 0
            while waiting:
                if not length:
                    edge = i
                child = edges.get(node * width + s[edge])
                if child is None:
                    edges[node * width + s[edge]] = len(begin)
                    begin.append(i), end.append(n), link.append(0)
                    if fork:
                        link[fork], fork = node, 0
                else:
                    span = end[child] - begin[child]
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    at = begin[child]
                    if s[at + length] == c:
                        length += 1
                        if fork:
                            link[fork] = node
                        break
                    split = len(begin)
                    begin += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    edges[node * width + s[edge]] = split
                    edges[split * width + c] = split + 1
                    begin[child] = at + length
                    edges[split * width + s[at + length]] = child
                    if fork:
                        link[fork] = split
                    fork = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - waiting + 1
        self.n = n
        self._walk(begin, end, edges, width)

    def _walk(self, begin: list[int], end: list[int], edges: dict[int, int], width: int) -> None:
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        to = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        parent, first, to = keys[order] // width, keys[order] % width, to[order]
        low = np.searchsorted(parent, np.arange(len(begin) + 1))
        down = np.lexsort((-first, first > 0, parent))  # the end first, then larger words before smaller
        lengths = np.asarray(end) - np.asarray(begin)
        self.rank, gaps = self._leaves(to.tolist(), low.tolist(), lengths.tolist())
        self.reversed_rank, _ = self._leaves(to[down].tolist(), low.tolist(), lengths.tolist())
        self.table = [np.asarray(gaps, np.int32)]  # gaps[k]: least depth between leaves k and k + 1
        while 2 << (len(self.table) - 1) <= len(gaps):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _leaves(self, to: list[int], low: list[int], lengths: list[int]) -> tuple[np.ndarray, list[int]]:
        rank, gaps, between, seen = np.zeros(self.n, np.int64), [], 0, []
        stack = [(0, 0, -1)]
        while stack:
            node, depth, above = stack.pop()
            if above >= 0:  # the tour comes back to the parent before this child
                between = above
            depth += lengths[node]
            a, b = low[node], low[node + 1]
            if a == b:
                if seen:
                    gaps.append(between)
                seen.append(self.n - depth)
            else:
                stack += [(child, depth, depth) for child in to[b - 1:a:-1]]
                stack.append((to[a], depth, -1))
        rank[seen] = np.arange(self.n)
        return rank, gaps

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next position whose suffix is smaller; the end is smaller than all."""
    out, stack = np.zeros(len(rank) - 1, np.int64), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return out


def runs_of(ids: list[int], least: int = LEAST, cube: int = CUBE) -> np.ndarray:
    """Start, length and period of every run of at least `least` words and `cube` (2 or more) periods."""
    n = len(ids)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward, backward = SuffixTree(ids), SuffixTree(ids[::-1])
    at, found = np.arange(n), []
    for rank in (forward.rank, forward.reversed_rank):
        period = _next_smaller(rank) - at
        start = at - backward.common(n - at, n - at - period)
        length = at + period + forward.common(at, at + period) - start
        some = length >= np.maximum(least, cube * period)
        found.append(np.stack([start, length, period], 1)[some])
    return np.unique(np.concatenate(found), axis=0)


def stretches(hashes: np.ndarray, counts: np.ndarray, least: int = LEAST, cube: int = CUBE, window: int = WINDOW
              ) -> tuple[np.ndarray, np.ndarray]:
    """Where runs can be: begin and end of stretches of words, given all texts' word hashes."""
    first, text = A.window_ids(counts, window)
    if not len(first):
        return first, first
    key = A.ranges(A.prefix(hashes, A.WORD_BASE), first, first + window, A.WORD_BASE) + A.mix(text.astype(A.U))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    away = first[order[1:]] - first[order[:-1]]
    near = np.full(len(first), np.iinfo(np.int64).max // cube)
    near[order[1:][same]] = away[same]
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], away[same])
    owner = np.repeat(np.arange(len(counts)), counts)
    low, high = first[:0], first[:0]
    limit = np.full(len(first), np.iinfo(np.int64).max // cube)
    for _ in range(3):  # shorter stretches need nearer windows
        here = first[near * cube <= limit]
        if not len(here):
            return here, here
        new = np.flatnonzero(np.concatenate([[True], (here[1:] > here[:-1] + window) | (owner[here[1:]] != owner[here[:-1]])]))
        low, high = here[new], here[np.append(new[1:], len(here)) - 1] + window
        limit = np.zeros(len(first), np.int64)
        of = np.searchsorted(low, first, side="right") - 1
        inside = (of >= 0) & (first + window <= high[of])
        limit[inside] = (high - low)[of[inside]]
        limit[limit < least] = 0
    long = high - low >= least
    return low[long], high[long]


def find(docs: DataFrame, *, text: str = "text", least: int = LEAST, cube: int = CUBE, drop: Sequence[str] = ()
         ) -> DataFrame:
    """Adds n_words, runs (by start, then period), top (the run with most periods; ties: smallest
    start, then period) and collapsed: the words joined by one blank, without those that a run
    holds after its first period."""
    if least < 3 * WINDOW or cube < 3:
        raise ValueError(f"runs of at least {3 * WINDOW} words and 3 periods can be found")
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("top", run),
              T.StructField("collapsed", T.StringType())]
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [c for c in docs.columns if c.lower() not in gone]
    schema = T.StructType([*(docs.schema[c] for c in keep), *fields])
    kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def per_portion(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]], list[dict | None], pa.Array]:
        starts, ends, words = A.words(data, offsets)
        counts = np.diff(words)
        low, high = stretches(A.word_hashes(data, starts, ends), counts, least, cube)
        runs, lost = [[] for _ in counts], np.zeros(len(starts) + 1, np.int64)
        for a, b in zip(low.tolist(), high.tolist()):
            numbers: dict[bytes, int] = {}
            ids = [numbers.setdefault(data[x:y].tobytes(), len(numbers)) for x, y in zip(starts[a:b], ends[a:b])]
            # Numbers in the order of the words' own bytes are not needed: any order of words will do.
            found = runs_of(ids, least, cube)
            of = int(np.searchsorted(words, a, side="right")) - 1
            runs[of] += [(s + a - int(words[of]), n, q) for s, n, q in found.tolist()]
            np.add.at(lost, found[:, 0] + a + found[:, 2], 1)
            np.add.at(lost, found[:, 0] + a + found[:, 1], -1)
        stays = np.flatnonzero(np.cumsum(lost)[:-1] == 0)
        owner = np.searchsorted(words, stays, side="right") - 1
        # Each kept word and the byte after it, but for a text's last kept word.
        closing = np.append(owner[1:] != owner[:-1], True) if len(stays) else np.zeros(0, bool)
        span = ends[stays] - starts[stays] + ~closing
        source = np.repeat(starts[stays], span) + A.runs(span)
        out = np.append(data, np.uint8(32))[source]
        out[np.cumsum(span)[~closing] - 1] = 32
        sizes = np.bincount(owner, weights=span, minlength=len(counts)).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)])
        joined = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(places), pa.py_buffer(out)])
        top = []
        for i, found in enumerate(runs):
            found.sort(key=lambda r: (r[0], r[2]))
            best = None
            for r in found:
                if best is None or r[1] * best[2] > best[1] * r[2]:
                    best = r
            top.append(best)
        named = lambda r: dict(zip(("start", "length", "period"), r))
        return counts, [[named(r) for r in found] for found in runs], [r and named(r) for r in top], joined

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.portions(batches, text):
            counts, runs, top, joined = per_portion(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array(counts.astype(np.int64)),
                 pa.array(runs, pa.list_(kind)), pa.array(top, kind), joined.cast(pa.string())], names=schema.names)

    return docs.mapInArrow(mapped, schema)
