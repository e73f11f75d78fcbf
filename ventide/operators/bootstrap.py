"""Cluster bootstrap: whole patients are resampled, never single rows.

Drawing S patients with replacement gives a patient a multiplicity; here it is a Poisson(1)
draw computed from a hash of (replicate, patient), the usual distributed form. All draws of a patient
are one small array beside its rows, and a replicate is a weighted aggregate: no row is ever copied.

Sums over replicates are arrays added up in each task before anything is shuffled. Metrics that need
the order of the scores come from one ordered pass: rows are cut into slices of scores, each slice
knows what all replicates hold above it, and walks down its scores with one running sum a replicate.
A score that very many patients share is summed up in each task first, so it is a few rows by then.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide import config as C
from ventide.functions.quantile import slice_of
from ventide.session import materialize, spread

# Cumulative probabilities of a Poisson variable with mean 1, as far as they can be told from 1.
POISSON_CDF = tuple(itertools.takewhile(
    lambda p: p < 1.0, itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(40))))


#: Slices of the ordered pass: from SLICES to MOST_SLICES, so that what the driver holds (slices x
#: replicates) stays within a few megabytes.
SLICES, MOST_SLICES, SLICE_ROWS = 64, 1000, 1_000_000
#: Rows of a task that are looked at together, and how many with one score are added up there.
BUFFER, TIED = 131_072, 4
BATCH = 4096


def weights(df: DataFrame, cluster: str, n: int, seed: int) -> DataFrame:
    """Each patient once, with its multiplicity in every replicate: one byte a replicate."""
    schema = T.StructType([df.schema[cluster], T.StructField("_w", T.BinaryType())])
    heads = [f"{seed}|{rep}|" for rep in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = []
            for name in batch.column("_name").to_pylist():
                digests = b"".join(hashlib.md5((head + name).encode()).digest()[:6] for head in heads)
                high, low = np.frombuffer(digests, ">u2").reshape(-1, 3).astype(np.float64), 65536.0
                u = ((high[:, 0] * low + high[:, 1]) * low + high[:, 2]) / 16.0**12
                drawn.append(np.searchsorted(POISSON_CDF, u, side="right").astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.binary())], names=schema.names)

    known = df.where(F.col(cluster).isNotNull()).select(cluster).distinct()
    # Hashing is most of the work here, so few patients are dealt to all cores too.
    return spread(known).select(cluster, F.col(cluster).cast("string").alias("_name")).mapInArrow(run, schema)


def interval(draws: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, 2.5 and 97.5 percentiles and count of the replicate values: a group has one a replicate."""
    edges = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return draws.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.avg(value).alias("mean"), edges[0].alias("lo"), edges[1].alias("hi"), F.count(value).alias("resamples"),
        F.avg((F.col(value) <= 0).cast("int")).alias("p_worse"),
    )


def replicate_sums(df: DataFrame, cluster: str, sums: Mapping[str, str], n: int, seed: int, by: str | None = None
                   ) -> DataFrame:
    """Weighted sums per replicate (and group of `by`, a column of few whole numbers): rep and one
    column per entry of `sums` (name -> column)."""
    slim = df.groupBy(cluster, *([by] if by else [])).agg(*[F.sum(c).cast("double").alias(name) for name, c in sums.items()])
    joined = slim.withColumn("_g", F.col(by).cast("long") if by else F.lit(0).cast("long")).join(
        weights(df, cluster, n, seed), cluster).select("_g", "_w", *sums)
    names = list(sums)
    schema = T.StructType([T.StructField("_g", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_g").fill_null(-1).to_numpy()
            w = _draws(batch.column("_w"), n).astype(np.float64)
            values = np.stack([batch.column(c).fill_null(0.0).to_numpy() for c in names])
            for g in np.unique(group):
                at = group == g
                held[int(g)] = held.get(int(g), 0) + values[:, at] @ w[at]
        if held:
            columns = [pa.array([list(m[i]) for m in held.values()], pa.list_(pa.float64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *columns], names=schema.names)

    part = joined.mapInArrow(run, schema)
    spread = part.select("_g", F.posexplode(F.arrays_zip(*names)).alias("rep", "_s"))  # replicates x groups a task
    out = spread.groupBy("_g", "rep").agg(*[F.sum(f"_s.{c}").alias(c) for c in names])
    return out.select(*([F.col("_g").alias(by)] if by else []), "rep", *names)


def band_rates(df: DataFrame, cluster: str, band: str, label: str, n: int = 400,
               seed: int = C.SEED) -> DataFrame:
    """Bootstrap interval of the event rate per band, widened by the tolerance."""
    known = df.where(F.col(label).isNotNull()).select(cluster, band, F.lit(1).alias("_one"), F.col(label).alias("_y"))
    sums = replicate_sums(known, cluster, {"n": "_one", "pos": "_y"}, n, seed, band)
    draws = sums.where("n > 0").select(band, (F.col("pos") / F.col("n")).alias("rate"))
    return interval(draws, "rate", (band,)).select(
        band, "mean", "lo", "hi", "resamples",
        F.greatest(F.col("lo") - C.BAND_RATE_TOLERANCE, F.lit(0.0)).alias("envelope_lo"),
        F.least(F.col("hi") + C.BAND_RATE_TOLERANCE, F.lit(1.0)).alias("envelope_hi"),
    )


# ------------------------------------------------------------ metrics of ordered scores
def _draws(packed: pa.Array, n: int, dtype: type = np.int8) -> np.ndarray:
    """Packed rows of n numbers as a matrix."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(dtype).reshape(-1, n)


def _weighted(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positives of each row in every replicate, from its draws or from sums made before."""
    w = batch.column("w")
    own = w.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((2, batch.num_rows, n))
    if own.any():
        draws = _draws(w.drop_null(), n)
        for held, c in zip(out, ("n", "pos")):
            held[own] = draws * batch.column(c).drop_null().to_numpy()[:, None].astype(np.float64)
    if not own.all():
        made = _draws(batch.column("made").drop_null(), 2 * n, np.int32)
        out[0, ~own], out[1, ~own] = made[:, :n], made[:, n:]
    return out[0], out[1]


_ROW = "p double, n long, pos long, w binary, made binary"
_ROW_ARROW = pa.schema([("p", pa.float64()), ("n", pa.int64()), ("pos", pa.int64()), ("w", pa.binary()), ("made", pa.binary())])


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BUFFER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _tied(n: int):
    """Adds up rows of a buffer that share their score with others. Sums are four bytes a replicate;
    rows too heavy for that pass as they are."""
    def summed(score: np.ndarray, counts: np.ndarray, draws: np.ndarray) -> pa.RecordBatch:
        """Rows in order of their score."""
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        made = np.zeros((len(first), 2 * n), np.int32)
        for low in range(0, len(score), BATCH):
            # The scores of a stretch; the first may go on from the stretch before.
            high = min(low + BATCH, len(score))
            a, b = np.searchsorted(first, low, "right") - 1, np.searchsorted(first, high, "left")
            starts = np.maximum(first[a:b], low) - low
            part = draws[low:high].astype(np.int32)
            for side in (0, 1):
                made[a:b, side * n:(side + 1) * n] += np.add.reduceat(part * counts[side, low:high, None], starts, axis=0)
        none = pa.nulls(len(first), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(score[first]), none, none, pa.nulls(len(first), pa.binary()), pa.array([m.tobytes() for m in made], pa.binary())],
            schema=_ROW_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffers(batches):
            p = table.column("p").to_numpy()
            counts = np.stack([table.column(c).to_numpy() for c in ("n", "pos")])
            _, of, count = np.unique(p, return_inverse=True, return_counts=True)
            many = (count[of] >= TIED) & bool(counts[0].sum() < 2**31 // 128)
            if many.any():
                order = np.flatnonzero(many)[np.argsort(-p[many], kind="stable")]
                w = table.column("w").combine_chunks()
                draws = np.concatenate([_draws(c, n) for c in (w.chunks if isinstance(w, pa.ChunkedArray) else [w])])
                at = np.flatnonzero(np.concatenate([[True], p[order][1:] != p[order][:-1]])).tolist()
                step = max(1, len(at) * BATCH * 4 // len(order))  # scores a batch, so that batches stay small
                for k in range(0, len(at), step):
                    rows = order[at[k]:at[k + step] if k + step < len(at) else len(order)]
                    yield summed(p[rows], counts[:, rows].astype(np.int32), draws[rows])
            for rest in table.filter(pa.array(~many)).to_batches():
                if rest.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*(rest.column(c).cast(_ROW_ARROW.field(c).type) for c in ("p", "n", "pos", "w")), pa.nulls(rest.num_rows, pa.binary())],
                        schema=_ROW_ARROW)
    return run


def _slice_totals(sliced: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Rows and positives of every slice in every replicate: at most MOST_SLICES arrays."""
    schema = "slice int, n array<double>, pos array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in (b.slice(low, BATCH) for b in batches for low in range(0, b.num_rows, BATCH)):
            slices = batch.column("slice").to_numpy()
            both = np.stack(_weighted(batch, n))
            for s in np.unique(slices):
                held[int(s)] = held.get(int(s), 0) + both[:, slices == s].sum(1)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), *(pa.array([list(m[i]) for m in held.values()], pa.list_(pa.float64())) for i in (0, 1))],
                names=["slice", "n", "pos"])

    part = sliced.mapInArrow(run, schema).select("slice", F.posexplode(F.arrays_zip("n", "pos")).alias("rep", "s"))
    sums = part.groupBy("slice", "rep").agg(F.sum("s.n").alias("n"), F.sum("s.pos").alias("pos"))
    rows = sums.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "pos"))).alias("s")).collect()
    return {r["slice"]: np.array([(x["n"], x["pos"]) for x in r["s"]]).T for r in rows}


class _Walk:
    """Running sums of all replicates down one slice."""

    def __init__(self, above: np.ndarray, total: np.ndarray, bins: int):
        self.above, self.total, self.bins = above.copy(), total, bins
        self.sums = np.zeros((5, total.shape[1]))  # ap, auc, brier, rows, positives
        self.gaps = np.zeros((bins, total.shape[1]))
        # An edge of the equal-mass bins is reached once so many scores are not above it.
        marks = np.outer(np.arange(1, bins) / bins, total[0] - 1)
        self.reached = np.ceil(marks - 1e-9) + 1

    def go(self, p: np.ndarray, n: np.ndarray, pos: np.ndarray) -> None:
        seen, hits = self.above[0] + np.cumsum(n, 0), self.above[1] + np.cumsum(pos, 0)
        score, negatives = p[:, None], n - pos
        self.sums += [
            np.divide(pos * hits, seen, out=np.zeros_like(seen), where=seen > 0).sum(0), (negatives * (hits - pos / 2)).sum(0),
            (pos * (1 - score) ** 2 + negatives * score**2).sum(0), n.sum(0), pos.sum(0)]
        below = self.total[0] - (seen - n)  # scores up to this one
        place = (below[None] >= self.reached[:, None]).sum(0) if len(p) * self.bins < 20_000 else sum(
            (below >= edge).astype(np.int64) for edge in self.reached)
        reps = n.shape[1]
        flat = np.bincount((place * reps + np.arange(reps)).ravel(), weights=(n * score - pos).ravel(), minlength=self.bins * reps)
        self.gaps += flat.reshape(self.bins, reps)
        self.above = np.stack([seen[-1], hits[-1]])


def ordered_metrics(df: DataFrame, score: str, cluster: str, n: int = 200, seed: int = C.SEED,
                    bins: int = C.RELIABILITY_BINS, drawn: DataFrame | None = None) -> DataFrame:
    """Average precision, ROC-AUC, Brier score and calibration error (equal-mass bins of the resample) of
    every replicate: rep, ap, auc, brier, ece. A resample without a positive has nulls for the first two.
    `drawn`: the patients' weights, if several scores share them."""
    known = df.where(F.col("y").isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(cluster, F.col(score).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    drawn = materialize(weights(known, cluster, n, seed)) if drawn is None else drawn
    heavy = counts.join(drawn, cluster).select("p", "n", "pos", F.col("_w").alias("w"))
    rows = materialize(heavy.mapInArrow(_tied(n), _ROW))
    slices = min(MOST_SLICES, max(SLICES, rows.count() // SLICE_ROWS))
    grid = [i / slices for i in range(1, slices)]
    edged = rows.withColumn("_edges", rows.agg(F.percentile_approx("p", grid, 10_000)).scalar())
    sliced = materialize(edged.withColumn("slice", slice_of(F.col("_edges"), F.col("p"), slices).cast("int")).drop("_edges"))
    totals = _slice_totals(sliced, n)
    above, seen = {}, np.zeros((2, n))
    for s in sorted(totals, reverse=True):
        above[s] = seen
        seen = seen + totals[s]
    whole = seen
    shape = T.StructType([T.StructField("rep", T.IntegerType()),
                          *(T.StructField(c, T.DoubleType()) for c in ("ap", "auc", "brier", "n", "pos")),
                          T.StructField("gaps", T.ArrayType(T.DoubleType()))])

    def told(walk: _Walk) -> pa.RecordBatch:
        gaps = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bins, pa.int32()), pa.array(np.ascontiguousarray(walk.gaps.T).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, walk.sums), gaps], names=shape.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, walk, held = None, None, None
        for batch in (b.slice(low, BATCH) for b in batches for low in range(0, b.num_rows, BATCH)):
            of, p = batch.column("slice").to_numpy(), batch.column("p").to_numpy()
            n_of, pos_of = _weighted(batch, n)
            new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (of[1:] != of[:-1])]))
            of, p, n_of, pos_of = of[new], p[new], np.add.reduceat(n_of, new), np.add.reduceat(pos_of, new)
            if held is not None:
                if held[:2] == (of[0], p[0]):
                    n_of[0] += held[2]
                    pos_of[0] += held[3]
                else:
                    walk.go(np.array([held[1]]), held[2][None], held[3][None])
            for s in dict.fromkeys(of.tolist()):
                if s != here:
                    if walk is not None:
                        yield told(walk)
                    here, walk = s, _Walk(above[s], whole, bins)
                at = np.flatnonzero(of == s)
                at = at[at < len(of) - 1]  # the last score may go on in the next batch
                if len(at):
                    walk.go(p[at], n_of[at], pos_of[at])
            held = (of[-1], p[-1], n_of[-1], pos_of[-1])
        if held is not None:
            walk.go(np.array([held[1]]), held[2][None], held[3][None])
            yield told(walk)

    walked = sliced.repartition("slice").sortWithinPartitions("slice", F.col("p").desc()).mapInArrow(run, shape)
    sums = walked.groupBy("rep").agg(
        *[F.sum(c).alias(c) for c in ("ap", "auc", "brier", "n", "pos")],
        F.array(*[F.sum(F.col("gaps")[k]) for k in range(bins)]).alias("gaps"))
    negatives = F.col("n") - F.col("pos")
    return sums.select(
        "rep", F.try_divide("ap", "pos").alias("ap"), F.try_divide(F.col("auc"), F.col("pos") * negatives).alias("auc"),
        F.try_divide("brier", "n").alias("brier"),
        F.try_divide(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.abs(g)), F.col("n")).alias("ece"))


METRICS = {"ap": True, "auc": True, "brier": False, "ece": False}  # whether more is better


def metric_intervals(df: DataFrame, score: str, cluster: str, n: int = 200, seed: int = C.SEED) -> DataFrame:
    """metric, mean, lo, hi and resamples of the four metrics of one score."""
    draws = ordered_metrics(df, score, cluster, n, seed).unpivot(["rep"], list(METRICS), "metric", "value")
    return interval(draws, "value", ("metric",)).drop("p_worse")


def metric_differences(df: DataFrame, a: str, b: str, cluster: str, n: int = 200, seed: int = C.SEED) -> DataFrame:
    """Interval of metric(a) - metric(b) on the same resampled patients; for losses the difference is
    turned round, so that p_worse is always the chance that a is worse."""
    base = df.where(F.col("y").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    drawn = materialize(weights(base, cluster, n, seed))
    left, right = (ordered_metrics(base, c, cluster, n, seed, drawn=drawn).unpivot(["rep"], list(METRICS), "metric", v)
                   for c, v in ((a, "_a"), (b, "_b")))
    gain = F.col("_a") - F.col("_b")
    signed = F.when(F.col("metric").isin([m for m, more in METRICS.items() if more]), gain).otherwise(-gain)
    draws = left.join(right, ["rep", "metric"]).select("rep", "metric", signed.alias("diff"))
    return interval(draws, "diff", ("metric",))


def ap_difference(df: DataFrame, a: str, b: str, cluster: str, n: int = 200, seed: int = C.SEED) -> DataFrame:
    """Interval of AP(a) - AP(b); both scores see the same resampled patients."""
    return metric_differences(df, a, b, cluster, n, seed).where("metric = 'ap'").drop("metric")


def brier_difference(df: DataFrame, a: str, b: str, cluster: str, n: int = 200,
                     seed: int = C.SEED) -> DataFrame:
    """Interval of Brier(b) - Brier(a), so that p_worse still means "a is worse".

    A mean needs only per-patient sums, not the order of the scores.
    """
    loss = lambda c: F.pow(F.col(c) - F.col("y"), 2)
    known = df.where(F.col("y").isNotNull()).select(cluster, F.lit(1).alias("_one"), (loss(b) - loss(a)).alias("_gain"))
    sums = replicate_sums(known, cluster, {"n": "_one", "gain": "_gain"}, n, seed)
    return interval(sums.where("n > 0").select((F.col("gain") / F.col("n")).alias("diff")), "diff")
