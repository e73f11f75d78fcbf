"""Chunked scans, as-of and interval joins and order statistics against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventide.functions.quantile import cumulate, quantiles
from ventide.operators.joins import asof_before, interval_state
from ventide.operators.scan import Running, range_window, scan

T0 = dt.datetime(2024, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


def readings(seed=1, stays=3, n=60, span=1500):
    rng = random.Random(seed)
    rows = []
    for stay in range(stays):
        # Stay 0 holds most of the rows: the hot key.
        for m in sorted(rng.sample(range(span), n * (4 if stay == 0 else 1))):
            rows.append((stay, at(m), rng.choice([None, float(rng.randint(0, 99))])))
    return rows


@pytest.mark.parametrize("width", [600, 7200, 86400])
def test_scan_matches_loop(spark, width):
    rows = readings()
    df = spark.createDataFrame(rows, "stay int, t timestamp, v double")
    out = scan(df, ["stay"], "t", {
        "last": Running("last", F.col("v")),
        "before": Running("last", F.col("v"), strict=True),
        "after": Running("last", F.col("v"), strict=True, reverse=True),
        "total": Running("sum", F.col("v")),
        "top": Running("max", F.col("v"), strict=True),
        "low": Running("min", F.col("v")),
        "all": Running("all_max", F.col("v")),
    }, width_s=width)
    got = {(r.stay, r.t): r for r in out.collect()}
    assert len(got) == len(rows)
    for stay in range(3):
        mine = [(t, v) for s, t, v in rows if s == stay]
        for i, (t, _) in enumerate(mine):
            upto = [v for _, v in mine[: i + 1] if v is not None]
            past = [v for _, v in mine[:i] if v is not None]
            rest = [v for _, v in mine[i + 1:] if v is not None]
            r = got[(stay, t)]
            assert r["last"] == (upto[-1] if upto else None)
            assert r["before"] == (past[-1] if past else None)
            assert r["after"] == (rest[0] if rest else None)
            assert r["total"] == (sum(upto) if upto else None)
            assert r["top"] == (max(past) if past else None)
            assert r["low"] == (min(upto) if upto else None)
            assert r["all"] == max(v for _, v in mine if v is not None)


@pytest.mark.parametrize("width", [3600, 86400])
def test_range_window_matches_loop(spark, width):
    rows = readings(2)
    df = spark.createDataFrame(rows, "stay int, t timestamp, v double")
    out = range_window(df, ["stay"], "t", {
        "ahead": (F.max("v"), 1, 3600), "back": (F.min("v"), -1800, 0)}, width_s=width)
    got = {(r.stay, r.t): (r.ahead, r.back) for r in out.collect()}
    assert len(got) == len(rows)
    for stay, t, _ in rows:
        mine = [(u, v) for s, u, v in rows if s == stay and v is not None]
        gap = lambda u: (u - t).total_seconds()  # noqa: E731, B023
        ahead = [v for u, v in mine if 1 <= gap(u) <= 3600]
        back = [v for u, v in mine if -1800 <= gap(u) <= 0]
        assert got[(stay, t)] == (max(ahead, default=None), min(back, default=None))


def test_range_window_edges(spark):
    rows = [(1, T0, 1.0), (1, T0 + dt.timedelta(seconds=1), 2.0), (1, at(360), 3.0),
            (1, at(360) + dt.timedelta(seconds=1), 9.0)]
    df = spark.createDataFrame(rows, "stay int, t timestamp, v double")
    out = range_window(df, ["stay"], "t", {"m": (F.max("v"), 1, 6 * 3600)})
    assert out.where(F.col("t") == F.lit(T0)).first()["m"] == 3.0


def test_asof_is_strictly_before(spark):
    left = spark.createDataFrame([(1, at(10)), (1, at(20)), (2, at(5))], "s int, t timestamp")
    right = spark.createDataFrame(
        [(1, at(10), "a"), (1, at(20), "b"), (1, at(15), "c")], "s int, e timestamp, m string")
    got = {(r.s, r.t): r.m for r in asof_before(left, right, ["s"], "t", "e", ["m"]).collect()}
    assert got == {(1, at(10)): None, (1, at(20)): "c", (2, at(5)): None}


@pytest.mark.parametrize("width", [900, 86400])
def test_interval_state_matches_pairs(spark, width):
    rng = random.Random(3)
    times = [(s, at(m)) for s in (1, 2) for m in rng.sample(range(600), 80)]
    spans = [(1, "a", at(50), at(50), 1.0), (1, "a", at(60), None, 2.0)]
    for _ in range(150):
        m = rng.randint(0, 600)
        spans.append((rng.choice([1, 1, 1, 2]), rng.choice("ab"), at(m),
                      at(m + rng.randint(0, 200)), round(rng.random(), 3)))
    # Touching a reading's instant on either side does not count as running.
    spans += [(1, "b", times[0][1], times[0][1] + dt.timedelta(minutes=5), 4.0),
              (1, "b", times[0][1] - dt.timedelta(minutes=5), times[0][1], 8.0)]
    left = spark.createDataFrame(times, "s int, t timestamp")
    right = spark.createDataFrame(spans, "s int, g string, b timestamp, e timestamp, r double")
    out = interval_state(left, right, "s", "t", "g", ["a", "b"], "b", "e", "r", width_s=width)
    got = {(r.s, r.t): r for r in out.collect()}
    assert len(got) == len(set(times))
    for s, t in times:
        for g in "ab":
            live = [(b, r) for s2, g2, b, e, r in spans
                    if s2 == s and g2 == g and b < t and (e or b) > t]
            row = got[(s, t)]
            assert row[f"{g}_running"] == int(bool(live))
            assert row[f"{g}_rate"] == pytest.approx(sum(r for _, r in live))
            oldest = max(((t - b).total_seconds() // 60 for b, _ in live), default=-1)
            assert row[f"{g}_minutes_since_start"] == oldest


def test_quantiles_with_a_dominant_value(spark):
    rng = np.random.default_rng(0)
    a = np.concatenate([np.full(500, 0.25), rng.random(1000)])
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in (1, 2)]
    df = spark.createDataFrame(rows, "g string, v double")
    fractions = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.fraction): r["quantile"] for r in quantiles(df, ["g"], "v", fractions).collect()}
    for f in fractions:
        assert got[("a", f)] == pytest.approx(float(np.quantile(a, f)), abs=1e-12)
        assert got[("b", f)] == pytest.approx(1 + f)


def test_cumulate_both_directions(spark):
    values = random.Random(5).sample(range(10_000), 700)
    df = spark.createDataFrame([(float(v), v % 7) for v in values], "v double, n int")
    for down in (False, True):
        rows = cumulate(df, [], "v", {"run": "n"}, descending=down).collect()
        total = 0
        for r in sorted(rows, key=lambda r: -r.v if down else r.v):
            total += r.n
            assert r.run == total


def test_balanced_sample_takes_the_first_draws_of_each_class(spark, monkeypatch):
    from ventide.operators import split
    rows = [(i // 2 if i % 7 == 0 else i, int(i % 3 == 0) if i % 11 else (None if i % 2 else 2)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int").repartition(3)
    u = {r.id: r.u for r in df.select("id", split.draw_fraction(split.C.SEED, "id").alias("u")).collect()}
    monkeypatch.setattr(split, "cumulate", None)  # no class is put in order as a whole
    for bins, total in ((1 << 16, None), (4, None), (1, 101), (64, 0), (2, 10_000)):
        monkeypatch.setattr(split, "BINS", bins)
        of = {y: sorted(((u[i], i) for i, z in rows if z == y)) for y in (0, 1, 2)}
        take = min(len(of[0]), len(of[1]), *([] if total is None else [total // 2]))
        want = []
        for y, drawn in of.items():  # equal draws stay together, and go if not all of them fit
            want += [(i, y) for v, i in drawn if sum(w <= v for w, _ in drawn) <= take]
        got = split.balanced_sample(df, "y", ["id"], total)
        assert got.columns == ["id", "y"] and sorted(tuple(r) for r in got.collect()) == sorted(want)
