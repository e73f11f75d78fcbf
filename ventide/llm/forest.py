"""MinHash near-duplicates with an LSH forest.

A text's set holds its distinct word shingles; texts with the same set are one class from the start.
Each class has TREES signature paths of DEPTH min-hashes. Per tree the classes are sorted by path, and
the neighbours of a class in sorted order are those it shares the longest prefixes with. How deep a
prefix has to be is left to each region: where many classes share many values only the longest counts.
Classes that share the first LEAST values are a region; pairs of a region whose components differ are
looked at. The sorted order is cut into ranges that Spark balances, however large one region is.

First each class takes, over all trees, the one direct neighbour of another component that shares the
longest prefix with it. These pairs, at most one a class, are confirmed on the full sets and joined into
components; ROUNDS such rounds turn groups of copies into one component. Then, in regions of at most
NEAREST + 1 classes, all neighbours within NEAREST count whose components still differ, and all of
these are confirmed. A region of more classes that is not one component by then is crowded: its classes are dealt into blocks, and every block meets every
other one in a task of its own (`crowded`), but for the members of the region's largest component among
themselves. Such a task tells which components meet, not which pairs, so that rows do not grow with
pairs. Candidates of these two steps are dropped whose whole signatures disagree by more than MARGIN
standard deviations from the threshold. A pair at the threshold shares LEAST values in some tree but for
a chance of (1 - 0.75 ** 2) ** 16, two in a million.

Classes have names of their own, given once when they are written. Rows with the same key and different
texts are therefore different classes; the smallest key of a component is looked up last.

Defined cases: texts without words have an empty set and link with nothing; a text with fewer words
than a shingle has its whole sequence as its only shingle; repeated rows are members of one class,
and each of them is told as kept or not by its key; a row without a key links with nothing, has no
component and is kept; an empty table gives an empty result; clashing columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ventide.llm import arrays as A
from ventide.llm.components import components
from ventide.llm.tables import stored

WIDTH = 5
SHARE = (75, 100)  # links: SHARE[1] * intersection >= SHARE[0] * union
TREES, DEPTH, LEAST, NEAREST, MARGIN = 16, 10, 2, 12, 5.0
ROUNDS = 2  # of the one neighbour with the longest common prefix
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20  # of a crowded region: what one task holds twice

_draws = np.random.default_rng(20_240_601)
_XOR = _draws.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _draws.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    data = A.lower_ascii(data)
    starts, ends, before = A.words(data, offsets)
    hashes = A.word_hashes(data, starts, ends)
    chain = A.prefix(hashes, A.WORD_BASE)
    counts = np.diff(before)
    whole = (counts > 0) & (counts < width)
    low, _ = A.window_ids(counts, width)
    grams = A.ranges(chain, low, low + width, A.WORD_BASE)
    short = A.ranges(chain, before[:-1][whole], before[1:][whole], A.WORD_BASE)
    cuts = np.concatenate([[0], np.cumsum(np.maximum(counts - width + 1, 0))])
    out = [np.unique(grams[a:b]) for a, b in zip(cuts, cuts[1:])]
    for i, h in zip(np.flatnonzero(whole), short):
        out[i] = np.array([h], A.U)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per set TREES x DEPTH min-hashes of 16 bits; of an empty set zeros."""
    out = np.zeros((TREES * DEPTH, len(sets)), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    filled = np.flatnonzero(sizes)
    step, low = 1 << 16, 0
    while low < len(filled):  # runs of sets that stay in the processor's cache
        total = np.cumsum(sizes[filled[low:]])
        high = low + max(1, int(np.searchsorted(total, step, side="right")))
        part = filled[low:high]
        x = (np.concatenate([sets[i] for i in part]) >> A.U(32)).astype(np.uint32)
        at = np.cumsum(sizes[part]) - sizes[part]
        for i in range(TREES * DEPTH):
            smallest = np.minimum.reduceat((x ^ _XOR[i]) * _TIMES[i], at)
            out[i, part] = (smallest ^ (smallest >> np.uint32(16))) & np.uint32(0xFFFF)
        low = high
    return out.T.copy()


def _signed(docs: DataFrame, key: str, text: str, carry: Sequence[str]) -> DataFrame:
    """key, n_shingles, a 128-bit fingerprint of the set, the signature and what is carried."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.portions(batches, text):
            sets = shingle_sets(data, offsets)
            marks = signatures(sets)
            prints = _prints(sets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(key)),
                 pa.array([len(s) for s in sets], pa.int64()),
                 *(pa.array(prints[:, i].copy()) for i in (0, 1)),
                 pa.array([m.tobytes() for m in marks], pa.binary()),
                 *(rows.column(rows.schema.get_field_index(c)) for c in carry)],
                names=[*fields, *carry])

    kinds = {"_id": T.LongType(), "n_shingles": T.LongType(), "_f1": T.LongType(), "_f2": T.LongType(),
             "_signature": T.BinaryType()}
    fields = list(kinds)
    schema = T.StructType([*(T.StructField(n, k) for n, k in kinds.items()), *(docs.schema[c] for c in carry)])
    return docs.select(F.col(key).cast("long").alias(key), text, *carry).mapInArrow(run, schema)


def _next_to(rows: list[np.ndarray], fresh: int, across: bool, nearest: int) -> tuple[np.ndarray, ...]:
    """Pairs of rows at most `nearest` apart in sorted order, in one tree, of different components,
    that share LEAST values at least, the values of their common prefix and the first row. `fresh` is the number of
    leading rows whose pairs among themselves are known."""
    tree, path, key, part, label = rows
    found = [np.zeros((4, 0), np.int64)]
    for step in range(1, nearest + 1):
        low = max(0, fresh - step)
        if len(key) - step <= low:
            continue
        i = np.arange(low, len(key) - step)
        j = i + step
        same = (tree[i] == tree[j]) & (path[i, :LEAST] == path[j, :LEAST]).all(axis=1) & (label[i] != label[j])
        if across:
            same &= part[i] != part[j]
        i, j = i[same], j[same]
        prefix = np.logical_and.accumulate(path[i] == path[j], axis=1).sum(axis=1)
        found.append(np.stack([key[i], key[j], prefix, i]))
    return tuple(np.concatenate(found, axis=1))


def _neighbours(across: bool, nearest: int):
    """Stream sorted rows; give pairs (edge false), and rows near the partition's ends (edge true)
    whose neighbours may lie in another partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, head, count = None, [], 0
        fields = ("tree", "path", "id", "part", "label")

        def told(edge, tree, path, a, b, part, prefix):
            n = len(a)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, edge)), pa.array(tree, pa.int32()),
                 pa.array(path, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(part, pa.int64()), pa.array(prefix, pa.int64())],
                names=["edge", "tree", "path", "a", "b", "part", "prefix"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tree, path, key, part, label = (batch.column(batch.schema.get_field_index(f)) for f in fields)
            values = np.frombuffer(b"".join(path.to_pylist()), np.uint16).reshape(-1, DEPTH)
            rows = [np.asarray(tree), values, np.asarray(key), np.asarray(part), np.asarray(label)]
            if not across and len(head) < nearest:
                head += [tuple(r[i] for r in rows) for i in range(min(nearest - len(head), len(rows[0])))]
            fresh = 0
            if carry is not None:
                fresh = len(carry[0])
                rows = [np.concatenate([c, r]) for c, r in zip(carry, rows)]
            a, b, prefix, at = _next_to(rows, fresh, across, nearest)
            if len(a):
                yield told(False, rows[0][at], [p.tobytes() for p in rows[1][at, :LEAST]], np.minimum(a, b), np.maximum(a, b),
                           [None] * len(a), prefix)
            carry = [r[-nearest:] for r in rows]
            count += batch.num_rows
        if carry is not None and not across:
            more = min(nearest, count - len(head))
            tail = [tuple(c[i] for c in carry) for i in range(len(carry[0]) - more, len(carry[0]))]
            ends = head + tail
            yield told(True, [int(e[0]) for e in ends], [e[1].tobytes() for e in ends], [int(e[2]) for e in ends],
                       [int(e[4]) for e in ends], [int(e[3]) for e in ends], [None] * len(ends))

    return run


_FOUND = "edge boolean, tree int, path binary, a long, b long, part long, prefix long"


def candidates(classes: DataFrame, nearest: int, without: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of classes (id, signature, label) with different labels that are at most
    `nearest` apart in some tree's order, with the longest common prefix over the trees. Pairs of the
    regions (tree, head) in `without` are left out."""
    size = 2 * DEPTH
    paths = classes.select("id", "label", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"),
                           F.substring("signature", t * size + 1, F.lit(size)).alias("path")))).alias("x"))
    ordered = (
        paths.select("x.tree", "x.path", "id", "label").repartitionByRange("tree", "path", "id")
        .sortWithinPartitions("tree", "path", "id").withColumn("part", F.spark_partition_id().cast("long"))
    )
    found = stored(ordered.mapInArrow(_neighbours(False, nearest), _FOUND), "neighbours")
    # What lies at the ends of the ranges: 2 x nearest rows per partition, whatever the input.
    ends = found.where("edge").select("tree", "path", F.col("a").alias("id"), "part", F.col("b").alias("label")).coalesce(1)
    over = ends.sortWithinPartitions("tree", "path", "id").mapInArrow(_neighbours(True, nearest), _FOUND)
    both = found.where("not edge").unionByName(over).select("tree", F.col("path").alias("head"), "a", "b", "prefix")
    if without is not None:
        both = both.join(without.select("tree", "head"), ["tree", "head"], "left_anti")
    return both.where("a < b").groupBy("a", "b").agg(F.max("prefix").alias("prefix"))


def closest(pairs: DataFrame) -> DataFrame:
    """Of each class's pairs with smaller ones, that with the longest common prefix."""
    best = pairs.groupBy("b").agg(F.max(F.struct("prefix", (-F.col("a")).alias("a"))).alias("x"))
    return best.select((-F.col("x.a")).alias("a"), "b")


def _doubtful(share: float) -> float:
    """The share of equal min-hashes that is MARGIN standard deviations below the threshold."""
    return share - MARGIN * float(np.sqrt(share * (1 - share) / (TREES * DEPTH)))


def estimated(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """The pairs with the share of equal min-hashes, where the threshold is within MARGIN."""
    least = _doubtful(share)
    left = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, sa, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "sa", "sb"))
            x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, TREES * DEPTH) for s in (sa, sb))
            alike = (x == y).mean(axis=1)
            near = alike >= least
            yield pa.RecordBatch.from_arrays(
                [a.filter(pa.array(near)), b.filter(pa.array(near)), pa.array(alike[near])], names=["a", "b", "alike"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, alike double")


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit fingerprints of sets."""
    return np.array([(A.mix(s).sum(), A.mix(s * A.U(A.WORD_BASE)).sum()) for s in sets], A.U).reshape(-1, 2).view(np.int64)


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in A.portions(batches, text):
            sets = shingle_sets(data, offsets)
            prints = _prints(sets)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(key)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "f1", "f2", "shingles"])

    return docs.mapInArrow(run, "doc long, f1 long, f2 long, shingles binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def _sets_of(docs: DataFrame, key: str, text: str, classes: DataFrame, ends: DataFrame, known: DataFrame | None = None
             ) -> DataFrame:
    """The shingle sets of the classes in `ends` (distinct ids), without the known ones.

    A class is found by a key and its fingerprint: other texts under the same key fall out. The keys
    grow with the documents, so both sides are always shuffled, never shipped whole.
    """
    if known is not None:
        ends = ends.join(known, "id", "left_anti")
    wanted = classes.join(ends.hint("merge"), "id", "left_semi").select("id", "doc", F.col("_f1").alias("f1"), F.col("_f2").alias("f2"))
    texts = docs.select(F.col(key).cast("long").alias("doc"), text).join(
        wanted.select("doc").distinct().hint("merge"), "doc", "left_semi")
    found = _sets(texts, "doc", text).dropDuplicates(["doc", "f1", "f2"])
    return found.join(wanted, ["doc", "f1", "f2"]).select("id", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("xa", "xb"))):
                x, y = (np.frombuffer(s.as_py(), A.U) for s in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(share[1] * common >= share[0] * (len(x) + len(y) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)).filter(mask) for c in ("a", "b")], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _regions(classes: DataFrame) -> DataFrame:
    """One row per class and tree with the region the class lies in."""
    size = 2 * DEPTH
    heads = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.cast("int").alias("tree"),
                           F.substring("signature", t * size + 1, F.lit(2 * LEAST)).alias("head")))
    return classes.select("id", "label", "n_shingles", F.explode(heads).alias("x")).select(
        "x.tree", "x.head", "id", "label", "n_shingles")


def _mixed(members: DataFrame, more_than: int) -> DataFrame:
    """The regions of more than `more_than` classes in several components: their largest component,
    and by the classes' weights how many blocks it (n_most) and the others (n_rest) take."""
    total = F.sum("weight").alias("weight")
    labels = members.groupBy("tree", "head", "label").agg(F.count("*").alias("n"), total)
    top = F.max(F.struct("n", "label", "weight")).alias("top")
    regions = labels.groupBy("tree", "head").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), total, top)
    blocks = lambda weight: F.greatest(F.ceil(weight), F.lit(1)).cast("int")
    return regions.where((F.col("n") > more_than) & (F.col("labels") > 1)).select(
        "tree", "head", F.col("top.label").alias("most"), blocks(F.col("top.weight")).alias("n_most"),
        blocks(F.col("weight") - F.col("top.weight")).alias("n_rest"))


def _dealt(members: DataFrame, regions: DataFrame, *values: str) -> DataFrame:
    """Every class once per task it belongs to. A task (tree, head, kind, i, j) compares block i with
    block j: of the rest with itself (kind 0), or of the largest component with the rest (kind 1).
    `second` tells the side; in a block compared with itself all rows are on the first one."""
    rows = members.join(regions, ["tree", "head"])
    big = F.col("label") == F.col("most")
    own = F.pmod(F.xxhash64(F.lit("block"), "id"), F.when(big, F.col("n_most")).otherwise(F.col("n_rest"))).cast("int")
    rows = rows.withColumn("_own", own)
    own = F.col("_own")

    def task(kind: int, i, j, second):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), second.alias("second"))

    rest = F.sequence(F.lit(0), F.col("n_rest") - 1)
    with_most = F.transform(rest, lambda j: task(1, own, j, F.lit(False)))
    with_rest = F.transform(rest, lambda j: task(0, F.least(own, j), F.greatest(own, j), own > j))
    to_most = F.transform(F.sequence(F.lit(0), F.col("n_most") - 1), lambda i: task(1, i, own, F.lit(True)))
    tasks = F.when(big, with_most).otherwise(F.concat(with_rest, to_most))
    return rows.withColumn("x", F.explode(tasks)).select(
        "tree", "head", "x.kind", "x.i", "x.j", "x.second", "id", "label", "n_shingles", *values)


_TASK = ("tree", "head", "kind", "i", "j")


def _comparable(rows: pa.Table, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of both sides of a task, and which pairs differ in component and may link by size."""
    second = np.asarray(rows["second"].to_numpy(zero_copy_only=False), bool)
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    alone = rows["kind"][0].as_py() == 0 and rows["i"][0] == rows["j"][0]
    right = left if alone else right
    label, size = rows["label"].to_numpy(), rows["n_shingles"].to_numpy()
    x, y = size[left][:, None], size[right][None, :]
    open_ = (label[left][:, None] != label[right][None, :]) & (
        share[1] * np.minimum(x, y) >= share[0] * np.maximum(x, y))
    return left, right, np.triu(open_, 1) if alone else open_


def _promising(least: float, share: tuple[int, int]):
    """Of a task's classes those with a partner that the signatures do not rule out. A pair counts
    in the first of the trees where it shares a region only."""
    def run(rows: pa.Table) -> pa.Table:
        left, right, pairs = _comparable(rows, share)
        tree = rows["tree"][0].as_py()
        marks = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint16).reshape(-1, TREES * DEPTH)
        for t in range(tree):
            if not pairs.any():
                break
            head = [marks[:, t * DEPTH + d] for d in range(LEAST)]
            pairs &= ~np.logical_and.reduce([h[left][:, None] == h[right][None, :] for h in head])
        a, b = np.nonzero(pairs)
        found = np.zeros(len(marks), bool)
        for low in range(0, len(a), 1 << 14):
            x, y = left[a[low:low + (1 << 14)]], right[b[low:low + (1 << 14)]]
            near = (marks[x] == marks[y]).mean(axis=1) >= least
            found[x[near]] = True
            found[y[near]] = True
        return rows.select(["tree", "head", "id"]).filter(pa.array(found))

    return run


def _meeting(share: tuple[int, int]):
    """Of a task's classes those that links of their full sets lead to, with the smallest id so led to."""
    def run(rows: pa.Table) -> pa.Table:
        left, right, pairs = _comparable(rows, share)
        sets = [np.frombuffer(s, A.U) for s in rows["shingles"].to_pylist()]
        size = np.array([len(s) for s in sets])
        common = np.zeros(pairs.shape, np.float32)
        x, y = (np.concatenate([sets[i] for i in side]) if len(side) else np.zeros(0, A.U) for side in (left, right))
        shared = np.intersect1d(x, y)
        sides = []
        for side, values in ((left, x), (right, y)):
            at = np.searchsorted(shared, values)
            kept = at < len(shared)
            kept[kept] = shared[at[kept]] == values[kept]
            owner = np.repeat(np.arange(len(side)), size[side])[kept]
            order = np.argsort(at[kept], kind="stable")
            sides.append((owner[order], at[kept][order]))
        step = 2048
        for low in range(0, len(shared), step):
            held = []
            for side, (owner, at) in zip((left, right), sides):
                a, b = np.searchsorted(at, [low, low + step])
                part = np.zeros((len(side), min(step, len(shared) - low)), np.float32)
                part[owner[a:b], at[a:b] - low] = 1
                held.append(part)
            common += held[0] @ held[1].T
        whole = size[left][:, None] + size[right][None, :]
        count = np.rint(common).astype(np.int64)
        a, b = np.nonzero(pairs & (share[1] * count >= share[0] * (whole - count)))
        a, b, ids = left[a], right[b], rows["id"].to_numpy()
        least, before = ids.copy(), None
        while before is None or (least != before).any():
            before = least.copy()
            np.minimum.at(least, a, before[b])
            np.minimum.at(least, b, before[a])
        led = least != ids
        return pa.table({"a": pa.array(least[led], pa.int64()), "b": pa.array(ids[led], pa.int64())})

    return run


def crowded(classes: DataFrame, docs: DataFrame, key: str, text: str, sets: DataFrame,
            share: tuple[int, int] = SHARE) -> DataFrame | None:
    """Links a, b between the components (label) of the regions that NEAREST does not exhaust, or None
    if there are none. `sets` has the known shingle sets."""
    members = _regions(classes).withColumn("weight", F.lit(1 / BLOCK))
    regions = stored(_mixed(members, NEAREST + 1), "crowded")
    if regions.isEmpty():
        return None
    signed = classes.select("id", "signature")
    inside = members.join(regions.select("tree", "head"), ["tree", "head"], "left_semi").join(signed, "id")
    tasks = _dealt(inside, regions, "signature")
    promising = tasks.groupBy(*_TASK).applyInArrow(
        _promising(_doubtful(share[0] / share[1]), share), "tree int, head binary, id long")
    promising = stored(promising.distinct(), "promising")
    weight = F.lit(1 / BLOCK) + F.col("n_shingles") / BLOCK_SHINGLES
    members = promising.join(classes.select("id", "label", "n_shingles"), "id").withColumn("weight", weight)
    regions = stored(_mixed(members, 1), "promising-regions")
    if regions.isEmpty():
        return None
    ends = promising.select("id").distinct()
    more = stored(_sets_of(docs, key, text, classes, ends, sets.select("id")), "sets-crowded")
    tasks = _dealt(members.join(sets.unionByName(more), "id"), regions, "shingles")
    return stored(tasks.groupBy(*_TASK).applyInArrow(_meeting(share), "a long, b long").distinct(), "links-crowded")


def classify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of `docs`: the key, n_shingles, component_id, kept and the columns in `carry`."""
    signed = stored(_signed(docs, key, text, carry), "signed")
    known = signed.where("n_shingles > 0 AND _id IS NOT NULL")
    first = F.min(F.struct("_id", "_signature", "n_shingles")).alias("_first")
    classes = known.groupBy("_f1", "_f2").agg(first).select(
        "_f1", "_f2", F.col("_first._id").alias("doc"), F.col("_first._signature").alias("signature"),
        F.col("_first.n_shingles").alias("n_shingles"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    # First each class's closest neighbour: a group of copies becomes one component.
    labelled, links, sets = classes.withColumn("label", F.col("id")), None, None
    for _ in range(ROUNDS):
        best = stored(closest(candidates(labelled, 1)), "closest")
        new = stored(_sets_of(docs, key, text, classes, _ends(best), None if sets is None else sets.select("id")), "sets")
        sets = new if sets is None else sets.unionByName(new)
        found = stored(confirmed(best, sets), "links-closest")
        links = found if links is None else links.unionByName(found)
        joined = stored(components(links), "components").withColumnRenamed("component", "label")
        labelled = classes.join(joined, "id", "left").withColumn("label", F.coalesce("label", "id"))
    # Then what lies further apart, where it is not in one component already; crowded regions come last.
    labelled = stored(labelled, "labelled")
    full = stored(_mixed(_regions(labelled).withColumn("weight", F.lit(1 / BLOCK)), NEAREST + 1), "full")
    wider = stored(estimated(candidates(labelled, NEAREST, full), classes, SHARE[0] / SHARE[1]), "alike-wider")
    sets = sets.unionByName(stored(_sets_of(docs, key, text, classes, _ends(wider), sets.select("id")), "sets-wider"))
    more = stored(confirmed(wider, sets), "links-wider")
    whole = stored(components(links.unionByName(more)), "components")
    # Then what is left of the regions that hold more than these neighbours.
    labelled = classes.join(whole.withColumnRenamed("component", "label"), "id", "left")
    labelled = stored(labelled.withColumn("label", F.coalesce("label", "id")), "labelled")
    rest = crowded(labelled, docs, key, text, sets)
    if rest is not None and not rest.isEmpty():
        joined = whole.select(F.col("component").alias("a"), F.col("id").alias("b"))
        whole = stored(components(joined.unionByName(rest)), "components")
    groups = classes.join(whole, "id", "left").select("_f1", "_f2", "doc", F.coalesce("component", "id").alias("component"))
    least = groups.groupBy("component").agg(F.min("doc").alias("_component"))
    groups = groups.join(least, "component").select("_f1", "_f2", "_component")
    return (
        signed.join(groups, ["_f1", "_f2"], "left")
        .select(
            F.col("_id").alias(key), "n_shingles", *carry,
            F.when(F.col("n_shingles") > 0, F.when(F.col("_id").isNotNull(), F.col("_component")))
            .otherwise(F.col("_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )
