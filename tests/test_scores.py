"""Metrics, bands, models and attribution against direct computation."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ventide.operators import bands, metrics, models
from ventide.operators.bands import Dwell, Machine

T0 = dt.datetime(2024, 1, 1)


def naive_ap_auc(y, p):
    thresholds = sorted(set(p), reverse=True)
    ap, seen, pos = 0.0, 0, sum(y)
    for t in thresholds:
        tp = sum(a for a, b in zip(y, p) if b >= t)
        n = sum(b >= t for b in p)
        ap += (tp - seen) / pos * tp / n
        seen = tp
    wins = sum((b > d) + 0.5 * (b == d) for (a, b), (c, d) in
               itertools.product(zip(y, p), zip(y, p)) if a == 1 and c == 0)
    return ap, wins / (pos * (len(y) - pos))


def test_rank_metrics_with_ties(spark):
    rng = random.Random(1)
    y = [int(rng.random() < 0.3) for _ in range(300)]
    p = [round(rng.random() * (0.6 + 0.4 * a), 1) for a in y]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    row = metrics.rank_metrics(df).first()
    ap, auc = naive_ap_auc(y, p)
    assert row.ap == pytest.approx(ap) and row.auc == pytest.approx(auc)
    assert row.brier == pytest.approx(np.mean((np.array(y) - np.array(p)) ** 2))


def test_single_class_is_null(spark):
    row = metrics.rank_metrics(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")).first()
    assert row.ap is None and row.auc is None


def test_reliability_edges_belong_above(spark):
    p = [0.1] * 50 + [0.5] * 30 + [0.9] * 20
    y = [i % 2 for i in range(100)]
    rows = metrics.reliability(spark.createDataFrame(list(zip(y, p)), "y int, p double")).collect()
    q = np.quantile(p, np.linspace(0, 1, 16))
    q[0], q[-1] = -np.inf, np.inf
    want = np.bincount(np.clip(np.searchsorted(q, p, side="right") - 1, 0, 14), minlength=15)
    assert {r.bin: r.n for r in rows} == {b: n for b, n in enumerate(want) if n}


def scored_rows(seed, stays=4, n=80, span=4000):
    rng = random.Random(seed)
    rows = []
    for s in range(stays):
        level = 0.4
        for m in sorted(rng.sample(range(span), n)):
            level = min(max(level + rng.uniform(-0.25, 0.25), 0.0), 1.0)
            rows.append((s, T0 + dt.timedelta(minutes=m), round(level, 2)))
    return rows


def replay(rows, machine):
    out = {}
    for s, group in itertools.groupby(rows, key=lambda r: r[0]):
        latches, last, shown, count = [bands.FRESH] * len(machine.cuts), None, 0, 0
        for _, t, p in group:
            minute = (t - T0).total_seconds() / 60
            gap = None if last is None else minute - last
            latches = [bands.step(c, f, machine.dwell, st, p, minute, gap)
                       for c, f, st in zip(machine.cuts, machine.floors, latches)]
            now = sum(st[0] for st in latches)
            count = count + 1 if now == shown else 1
            shown, last = now, minute
            out[(s, t)] = (shown, count)
    return out


@pytest.mark.parametrize("dwell,width", [
    (Dwell(0.0, 1, 0.0, 0.0, 240.0), 86400),
    (Dwell(30.0, 2, 0.25, 60.0, 60.0), 86400),
    (Dwell(60.0, 3, 0.5, 120.0, 90.0), 43200),
])
def test_bands_as_windows_equal_the_machine(spark, dwell, width):
    rows = scored_rows(int(dwell.promote_min))
    machine = Machine((0.3, 0.5, 0.7), dwell)
    df = spark.createDataFrame(rows, "stay_id int, charttime timestamp, p double")
    views = bands.band_views(df, machine, width_s=width).collect()
    want = replay(rows, machine)
    assert len(views) == len(rows)
    for v in views:
        assert (v.displayed_index, v.readings_in_state) == want[(v.stay_id, v.charttime)]


def test_latch_boundaries():
    d = Dwell(10.0, 2, 0.5, 10.0, 60.0)
    s = bands.step(0.5, 0.25, d, bands.FRESH, 0.5, 0.0, None)
    assert s == bands.FRESH                                  # equal to the cut is not above it
    s = bands.step(0.5, 0.25, d, s, 0.6, 0.0, None)
    s = bands.step(0.5, 0.25, d, s, 0.6, 70.0, 70.0)         # the gap restarts the run
    assert s[0] is False and s[2] == 1
    s = bands.step(0.5, 0.25, d, s, 0.6, 80.0, 10.0)
    assert s[0] is True
    s = bands.step(0.5, 0.25, d, s, 0.3, 200.0, 120.0)       # a gap never drops a latch
    assert s[0] is True
    late = bands.step(0.5, 0.25, d, (False, 0.0, 0), 0.9, 30.0, 5.0)
    assert late == (False, 0.0, 1)                           # dwell met, too few readings


def test_machine_rules():
    with pytest.raises(ValueError):
        Machine((0.5, 0.3, 0.7))
    with pytest.raises(ValueError):
        Machine((0.3, 0.3, 0.7), Dwell(demote_margin=0.0))
    m = Machine((0.2, 0.4, 0.8))
    assert Machine.from_json(m.to_json()) == m


def test_shapley_is_exact():
    # if x0 <= 0: (x1 <= 0: 1 else 5) else 10; shares of rows 0.4/0.6 and 0.5/0.5
    leaves = [
        (1.0, ((0, True, 0.0, 0.4), (1, True, 0.0, 0.5))),
        (5.0, ((0, True, 0.0, 0.4), (1, False, 0.0, 0.5))),
        (10.0, ((0, False, 0.0, 0.6),)),
    ]
    x = np.array([[-1.0, -1.0], [-1.0, 1.0], [1.0, 1.0]])
    values, bias = models.shapley(leaves, x)
    assert bias == pytest.approx(0.4 * 3 + 0.6 * 10)
    assert values.sum(axis=1) + bias == pytest.approx([1.0, 5.0, 10.0])

    def game(row, known):
        left = float(row[0] <= 0) if 0 in known else 0.4
        low = float(row[1] <= 0) if 1 in known else 0.5
        return left * (low * 1 + (1 - low) * 5) + (1 - left) * 10

    row = x[1]
    first = 0.5 * ((game(row, {0}) - game(row, set())) + (game(row, {0, 1}) - game(row, {1})))
    assert values[1, 0] == pytest.approx(first)


def test_platt_keeps_ranking_and_fixes_level(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < x / 4), x) for x in (rng.uniform(0.02, 0.98) for _ in range(1500))]
    df = spark.createDataFrame(rows, "y int, p double")
    slope, intercept = models.fit_platt(df)
    out = metrics.rank_metrics(df.withColumn("p", models.apply_platt(F.col("p"), slope, intercept))).first()
    raw = metrics.rank_metrics(df).first()
    assert slope > 0 and out.ap == pytest.approx(raw.ap, abs=1e-9)
    assert out.mean_predicted == pytest.approx(out.positive_rate, abs=1e-4)


def test_documentation_share():
    assert metrics.documentation_share(0.5, 0.3, 0.1) == pytest.approx(0.5)
    assert metrics.documentation_share(0.5, 0.3, 0.5) is None


def test_sliding_windows(spark):
    from ventide.operators.impute import sliding_windows
    rows = [(s, T0 + dt.timedelta(minutes=7 * i), float(i)) for s, n in ((1, 50), (2, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "stay_id int, charttime timestamp, v double")
    got = {(r.stay_id, r.window): r["values"] for r in
           sliding_windows(df, "v", 10, 4, width_s=3600).collect()}
    assert got == {(1, k): [float(4 * k + j) for j in range(10)] for k in range(11)}


def test_band_artifact_contract():
    machine = Machine((0.3, 0.5, 0.7))
    table = [{"displayed_index": i, "band": n, "share": s, "observed_rate": r} for i, (n, s, r) in
             enumerate(zip(machine.names, (0.7, 0.2, 0.07, 0.03), (0.03, 0.11, 0.25, 0.5)))]
    edges = [{"displayed_index": i, "envelope_lo": 0.0, "envelope_hi": 0.6} for i in range(4)]
    art = bands.artifact(machine, table, edges, 0.08, {"model": "x"})
    assert all(ok for _, ok in bands.artifact_checks(art))
    art["bands"][3]["observed_rate"] = 0.2
    assert {"rates rise", "lift is rate over base"} <= {n for n, ok in bands.artifact_checks(art) if not ok}


def test_gate_verdict():
    better, worse = {"hi": 0.01}, {"hi": -0.01}
    assert metrics.gate_verdict(better, 0.20, 0.205)["accepted"]
    assert metrics.gate_verdict(worse, 0.2, 0.2)["reasons"] == ["metric below baseline"]
    assert not metrics.gate_verdict(better, 0.20, 0.22)["accepted"]


def test_choice_of_hysteresis():
    plain = dict(dwell=Dwell(0.0, 1, 0.0, 0.0), flips_per_day=2.0, sensitivity_high=0.3, lost_lead_median_min=0.0)
    good = dict(dwell=Dwell(30.0, 2, 0.25, 60.0), flips_per_day=1.0, sensitivity_high=0.4, lost_lead_median_min=5.0)
    slow = dict(dwell=Dwell(60.0, 2, 0.5, 120.0), flips_per_day=0.5, sensitivity_high=0.9, lost_lead_median_min=45.0)
    assert bands.choose([plain, good, slow]) is good
    assert len(bands.sweep_dwells()) == 27


def test_choice_breaks_ties_and_keeps_detection():
    def row(dwell, sens, flips, lost):
        return {"dwell": dwell, "sensitivity_high": sens, "flips_per_day": flips, "lost_lead_median_min": lost}

    plain = row(bands.Dwell(0.0, 1, 0.0, 0.0), 0.5, 4.0, 0.0)
    calm = row(bands.Dwell(30.0, 2, 0.25, 60.0), 0.6, 2.0, 20.0)
    busy = row(bands.Dwell(15.0, 2, 0.25, 60.0), 0.6, 3.0, 5.0)
    quick = row(bands.Dwell(30.0, 2, 0.5, 60.0), 0.6, 2.0, 10.0)
    assert bands.choose([plain, busy, calm, quick]) is quick
    worse = row(bands.Dwell(30.0, 2, 0.25, 60.0), 0.4, 1.0, 0.0)
    with pytest.raises(ValueError):
        bands.choose([{**plain, "lost_lead_median_min": 99.0}, worse])
