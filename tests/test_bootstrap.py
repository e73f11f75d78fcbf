"""Replicate metrics against rows that are really resampled."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from ventide.operators import bootstrap


def resampled(rows, draws, rep, bins=15):
    """ap, auc, brier and ece of one replicate, row by row."""
    y, p = [], []
    for who, score, label in rows:
        y += [label] * draws[who][rep]
        p += [score] * draws[who][rep]
    y, p = np.array(y), np.array(p)
    if not len(y):
        return None, None, None, None
    positives, negatives = y.sum(), len(y) - y.sum()
    ap = auc = None
    if positives:
        ap = sum(y[p == s].sum() * y[p >= s].sum() / (p >= s).sum() for s in set(p.tolist())) / positives
    if positives and negatives:
        auc = np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])
    edges = np.quantile(p, np.arange(1, bins) / bins)
    place = (edges[None] <= p[:, None]).sum(1)
    ece = sum(abs((p - y)[place == b].sum()) for b in range(bins)) / len(y)
    return ap, auc, ((p - y) ** 2).mean(), ece


@pytest.mark.parametrize("tied, batch, slices", [(16, 4096, 64), (2, 3, 5)])
def test_metrics_against_resampled_rows(spark, monkeypatch, tied, batch, slices):
    for name, value in (("TIED", tied), ("BATCH", batch), ("SLICES", slices)):
        monkeypatch.setattr(bootstrap, name, value)
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.choice([0.5, 0.25, round(rng.random(), 3)]), int(rng.random() < 0.2)) for _ in range(150)]
    df = spark.createDataFrame([*rows, (1, None, 1), (2, 0.4, None)], "who int, p double, y int")
    n = 20
    draws = {r["who"]: r["_w"] for r in bootstrap.weights(df, "who", n, 42).collect()}
    got = {r["rep"]: r for r in bootstrap.ordered_metrics(df, "p", "who", n).collect()}
    for rep in range(n):
        want = resampled(rows, draws, rep)
        assert [got[rep][m] for m in bootstrap.METRICS] == pytest.approx(list(want), abs=1e-9)


def test_rows_of_a_task_are_added_up_by_score():
    rng = np.random.default_rng(5)
    n, size = 7, 30_000
    p, w = rng.integers(0, 100, size) / 100, rng.integers(0, 4, (size, n)).astype(np.int8)
    p[:3] = 2.0, 3.0, 4.0
    count, pos = rng.integers(1, 5, size), rng.integers(0, 2, size)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(p), pa.array(count), pa.array(pos), pa.array([r.tobytes() for r in w], pa.binary())], names=["p", "n", "pos", "w"])
    parts = [rows.slice(low, 5_000) for low in range(0, size, 5_000)]
    made = list(bootstrap._tied(n)(iter(parts)))
    assert sum(b.num_rows for b in made) == 103  # one row a score; batches alone would leave 600
    got = {}
    for batch in made:
        for score, *sums in zip(batch.column("p").to_pylist(), *bootstrap._weighted(batch, n)):
            got[score] = np.stack(sums)
    for score in np.unique(p):
        at = p == score
        assert np.array_equal(got[score], [count[at] @ w[at], pos[at] @ w[at]])


def test_no_positives(spark):
    df = spark.createDataFrame([(i, i / 10, 0) for i in range(8)], "who int, p double, y int")
    rows = bootstrap.ordered_metrics(df, "p", "who", 10).collect()
    assert all(r["ap"] is None and r["auc"] is None for r in rows) and any(r["ece"] is not None for r in rows)
    told = {r["metric"]: r for r in bootstrap.metric_intervals(df, "p", "who", 10).collect()}
    assert set(told) == {"brier", "ece"} and told["brier"]["lo"] <= told["brier"]["mean"] <= told["brier"]["hi"]


def test_sums_per_group(spark):
    rows = [(i % 7, i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "who int, grp int, v double")
    draws = {r["who"]: r["_w"] for r in bootstrap.weights(df, "who", 6, 42).collect()}
    got = {(r["grp"], r["rep"]): r["s"] for r in bootstrap.replicate_sums(df, "who", {"s": "v"}, 6, 42, "grp").collect()}
    for g in range(3):
        for rep in range(6):
            assert got[g, rep] == sum(v * draws[w][rep] for w, k, v in rows if k == g)


def test_p_worse_is_about_the_first_score(spark):
    rng = random.Random(3)
    rows = [(i % 20, i % 4 == 0, rng.random()) for i in range(400)]
    df = spark.createDataFrame([(w, int(y), 0.8 if y else 0.1 + u / 10, u) for w, y, u in rows], "who int, y int, a double, b double")
    told = {r["metric"]: r for r in bootstrap.metric_differences(df, "a", "b", "who", 20).collect()}
    assert set(told) == set(bootstrap.METRICS) and all(r["p_worse"] == 0 and r["mean"] > 0 for r in told.values())
