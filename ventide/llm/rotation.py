"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector is rotated at random and only the signs are kept. The stored factor, the inner product
of the rotated vector with its own signs, turns the product of signs and another rotated vector into
an unbiased estimate of the cosine, with an error bound that holds but for a small chance. Pairs
whose bound stays below the threshold are done; the others are recomputed exactly, in double
precision.

Which pairs meet at all is decided by the same codes: blocks of the signs of several rotations are
the keys of TABLES hash tables, with so many bits that a bucket keeps a bounded size as rows grow, and
so many tables that a pair at the threshold misses all of them with a chance of MISS. Equal vectors
are one class. A bucket larger than BLOCK is split into blocks, and pairs of blocks are tasks of
their own, so no bucket is ever in one task. A pair found in several tables counts in the first only.
Pairs never leave their task: it gives sums of links, and each vector's smallest partner.

Defined cases: null and zero vectors, and those with null or non-finite components, link with nothing,
as do rows without a key; vectors of different lengths are not compared; repeated rows are links of
each other; an empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide.llm.components import components
from ventide.llm.tables import stored

MISS, PER_BUCKET, BLOCK, STEP = 1e-4, 32, 1024, 1 << 15
DOUBT = 4.0  # half-width of the estimate's interval, in its standard deviations


@functools.lru_cache(64)
def rotation(width: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng([width, number, 5]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many rows."""
    bits = int(min(24, max(4, round(math.log2(max(rows, 2) / PER_BUCKET)))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def sign_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Per vector one integer key per table: consecutive blocks of the signs of all rotations."""
    width = unit.shape[1]
    signs = np.concatenate([unit @ rotation(width, k) > 0 for k in range(-(-bits * tables // width))], axis=1)
    blocks = signs[:, :bits * tables].reshape(len(unit), tables, bits)
    return blocks @ (1 << np.arange(bits, dtype=np.int64))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs (+-1) and coordinates of the rotated vectors, and the correction factor."""
    turned = unit @ rotation(unit.shape[1], 0)
    signs = np.where(turned > 0, 1.0, -1.0)
    return signs, turned, np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, digest and doubles of the vectors that can be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key)).to_pylist()
            column = batch.column(batch.schema.get_field_index(vector)).cast(pa.list_(pa.float64()))
            values = column.flatten()
            flat = np.where(np.asarray(values.is_null()), np.nan, values.fill_null(0).to_numpy(zero_copy_only=False))
            sizes = np.array([0 if s is None else s for s in column.value_lengths().to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            keep, data = [], []
            for i, (low, high) in enumerate(zip(ends - sizes, ends)):
                v = flat[low:high]
                norm = np.sqrt((v * v).sum())
                if ids[i] is not None and len(v) and np.isfinite(norm) and norm > 0:
                    keep.append(ids[i])
                    data.append((v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(data, pa.binary())],
                                             names=["id", "vector"])

    found = vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, "id long, vector binary")
    return found.withColumn("digest", F.sha2("vector", 256))


def _keyed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("vector")).to_pylist()
            out = np.zeros((len(raw), tables), np.int64)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                out[at] = sign_keys(v / np.linalg.norm(v, axis=1, keepdims=True), bits, tables) + (int(size) << 30)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * tables, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "weight", "vector")), keys],
                names=["id", "weight", "vector", "keys"])

    return classes.select("id", "weight", "vector").mapInArrow(
        run, "id long, weight long, vector binary, keys array<long>")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys of a stream in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(new), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if held and (low or first != last):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(low, high - low))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _smallest_in_reach(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per row the smallest id it reaches by the links a-b of one task."""
    label = ids.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            return label
        label = new


def linked(v: np.ndarray, rows: np.ndarray, others: np.ndarray, threshold: float,
           skip: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other) at or above the threshold; row < other where the two lists are one.

    Rows are taken in steps. `skip` tells the pairs that an earlier table has found.
    """
    norm = np.linalg.norm(v, axis=1)
    unit = v / norm[:, None]
    width = v.shape[1]
    signs, turned, factor = codes(unit)
    error = DOUBT * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(width - 1, 1))
    same = rows is others
    out_a, out_b = [], []
    for low in range(0, len(rows), 256):
        part = rows[low:low + 256]
        estimate = signs[part] @ turned[others].T / (math.sqrt(width) * factor[part][:, None])
        near = estimate + error[part][:, None] >= threshold
        if same:
            near &= np.arange(len(others))[None, :] > (low + np.arange(len(part)))[:, None]
        i, j = np.nonzero(near)
        for at in range(0, len(i), STEP):
            a, b = part[i[at:at + STEP]], others[j[at:at + STEP]]
            exact = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
            good = exact >= threshold
            a, b = a[good], b[good]
            fresh = ~skip(a, b)
            out_a.append(a[fresh])
            out_b.append(b[fresh])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _compared(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["t", "bucket", "low", "high"]):
            if group.num_rows < 2:
                continue
            get = lambda c: group.column(group.schema.get_field_index(c))
            ids, weight, block = (np.asarray(get(c)) for c in ("id", "weight", "block"))
            table, low, high = get("t")[0].as_py(), get("low")[0].as_py(), get("high")[0].as_py()
            v = np.frombuffer(b"".join(get("vector").to_pylist())).reshape(len(ids), -1)
            keys = np.asarray(get("keys").flatten()).reshape(len(ids), -1)[:, :table]
            rows = np.flatnonzero(block == low)
            others = rows if low == high else np.flatnonzero(block == high)
            skip = lambda a, b: (keys[a] == keys[b]).any(axis=1)  # noqa: E731, B023
            a, b = linked(v, rows, others, threshold, skip)
            if not len(a):
                continue
            links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
            root = _smallest_in_reach(len(ids), a, b, ids)
            some = links > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])],
                names=["id", "links", "root"])

    return run


def classify(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding",
             threshold: float = 0.95) -> DataFrame:
    """One row per row of `vectors`: the key, n_links, component_id and kept."""
    clean = stored(_clean(vectors, key, vector), "vectors")
    rows = clean.count()
    bits, tables = plan(rows, threshold)
    classes = clean.groupBy("digest").agg(
        F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = stored(classes, "vector-classes")
    keyed = stored(_keyed(classes, bits, tables), "vector-keys")
    entries = keyed.select("*", F.posexplode("keys").alias("t", "bucket"))
    crowded = stored(
        entries.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select(F.col("t").alias("_t"), F.col("bucket").alias("_bucket"),
                F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "crowded")
    placed = (
        entries.join(crowded, (F.col("t") == F.col("_t")) & (F.col("bucket") == F.col("_bucket")), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .select("t", "bucket", "low", "high", "block", "id", "weight", "vector", "keys")
    )
    order = ["t", "bucket", "low", "high"]
    found = stored(
        placed.repartition(*order).sortWithinPartitions(*order)
        .mapInArrow(_compared(threshold), "id long, links long, root long"), "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select("id", "root"))
    known = (
        classes.join(sums, "id", "left").join(joined, "id", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
    )
    told = clean.select("id", "digest").join(known, "digest").select(
        F.col("id").alias(key), "n_links", "component_id")
    single = vectors.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).join(
        clean.select(F.col("id").alias(key)), key, "left_anti")
    lost = vectors.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key))
    alone = single.unionByName(lost).select(key, F.lit(0).cast("long").alias("n_links"),
                                            F.col(key).alias("component_id"))
    return told.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
