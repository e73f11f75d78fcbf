"""The sweep against machines stepped one reading at a time."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from ventide.operators import bands, sweep
from ventide.operators.bands import Dwell, Machine

T0 = dt.datetime(2024, 1, 1)
DWELLS = [Dwell(0.0, 1, 0.0, 0.0), Dwell(30.0, 2, 0.25, 60.0), Dwell(60.0, 2, 0.5, 120.0), Dwell(30.0, 2, 0.0, 0.0)]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for stay in range(6):
        minute, level = 0, 0.5
        for _ in range(120 if stay else 400):
            minute += rng.choice([5, 15, 15, 30, 60, 400])
            level = min(1.0, max(0.0, level + rng.uniform(-0.25, 0.25)))
            out.append((stay, T0 + dt.timedelta(minutes=minute), round(level, 3), int(rng.random() < level / 3)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "stay_id long, charttime timestamp, p double, y int").repartition(4)


def stepped(rows, cut, floor, dwell):
    """Displayed state after every reading, per stay."""
    out = {}
    for stay in sorted({r[0] for r in rows}):
        state, last, lit = bands.FRESH, None, []
        for _, t, p, _ in sorted(r for r in rows if r[0] == stay):
            minute = (t - T0).total_seconds() / 60
            state = bands.step(cut, floor, dwell, tuple(state), p, minute, None if last is None else minute - last)
            last = minute
            lit.append(state[0])
        out[stay] = lit
    return out


@pytest.mark.parametrize("width_s", [1, 86_400])
def test_promotions_against_the_stepper(spark, rows, width_s):
    cuts, below = np.array([[0.2, 0.45, 0.6, 0.9]]), np.array([[0.0], [0.1], [0.0], [0.15]])
    got = sweep.promotions(sweep.chunked(frame(spark, rows), DWELLS, width_s), sweep.Latches.of(DWELLS, cuts, below))
    for i, dwell in enumerate(DWELLS):
        for j, cut in enumerate(cuts[0]):
            floor = cut - dwell.demote_margin * (cut - below[i, 0])
            lit = stepped(rows, cut, floor, dwell)
            assert got[i, j] == sum(b and not a for states in lit.values() for a, b in zip([False, *states], states))
    assert got.sum() > 50


@pytest.mark.parametrize("width_s", [1, 86_400])
def test_evaluation_against_the_stepper(spark, rows, width_s):
    machines = [Machine((0.3, 0.5, 0.8), d) for d in DWELLS[:3]] + [Machine((0.2, 0.6, 0.7), DWELLS[1])]
    base = frame(spark, rows)
    got = {r["setting"]: r for r in sweep.evaluate(base, sweep.chunked(base, DWELLS, width_s), machines).collect()}
    days = len({(s, t.replace(minute=0)) for s, t, *_ in rows}) / 24
    for i, m in enumerate(machines):
        lit = [stepped(rows, c, f, m.dwell) for c, f in zip(m.cuts, m.floors)]
        flips = caught = positive = 0
        lost, lost_positive = [], []
        for stay in lit[0]:
            mine = sorted(r for r in rows if r[0] == stay)
            shown = [sum(x) for x in zip(*(latch[stay] for latch in lit))]
            raw = [sum(p > c for c in m.cuts) for _, _, p, _ in mine]
            flips += sum(a != b for a, b in zip(shown, shown[1:]))
            positive += sum(r[3] for r in mine)
            caught += sum(r[3] for r, d in zip(mine, shown) if d >= 2)
            if max(raw) >= 2:
                first = next((r[1] for r, d in zip(mine, shown) if d >= 2), mine[-1][1])
                minutes = (first - next(r[1] for r, d in zip(mine, raw) if d >= 2)).total_seconds() / 60
                lost.append(minutes)
                lost_positive += [minutes] if any(r[3] for r in mine) else []
        want = (flips / days, caught / positive, np.median(lost), np.percentile(lost, 90), np.median(lost_positive))
        assert [got[i][c] for c in ("flips_per_day", "sensitivity_high", "lost_lead_median_min", "lost_lead_p90_min",
                                    "lost_lead_median_min_positive")] == pytest.approx(list(want))


def test_search_takes_the_high_side_of_the_hump():
    rates = np.array([0.1, 0.2, 2.0, 3.0, 2.0, 1.1, 0.9, 0.4, 0.1, 0.0])
    assert sweep.search(rates, 1.0, coarse=4) == (6, 5)
    assert sweep.search(rates, 0.05, coarse=10) == (9, 8)
    with pytest.raises(ValueError, match="never binds"):
        sweep.search(rates, 5.0)
    with pytest.raises(ValueError, match="highest cut"):
        sweep.search(rates, -1.0)


def test_sweep_chooses_among_what_can_be_solved(spark, rows):
    base = frame(spark, rows)
    chunks = sweep.chunked(base, DWELLS)
    grid, days = bands.score_grid(base, 60), bands.patient_days(base).first()["days"]
    peak = max(sweep.promotions(chunks, sweep.Latches.of(DWELLS[:1], np.array([grid]), np.array([[0.0]])))[0]) / days
    with pytest.raises(ValueError, match="without hysteresis"):
        bands.choose([{"dwell": DWELLS[1], "flips_per_day": 1.0, "sensitivity_high": 0.5, "lost_lead_median_min": 0.0}])
    results = sweep.sweep(base, bands.sweep_dwells(), budgets=(peak * 0.9, peak * 0.6, peak * 0.2), points=60)
    assert results[0]["dwell"] == DWELLS[0] and results[0]["rejected"] is None
    assert len(results) == 27 and sum(bool(r.get("chosen")) for r in results) == 1
    for r in results:
        assert (r["rejected"] is None) == ("machine" in r)
        for s in r["solved"]:
            assert s["promotions_per_day"] <= s["budget"] < s["rate_just_below"]
    with pytest.raises(ValueError, match="gap"):
        sweep.Latches.of([Dwell(), Dwell(max_gap_min=1.0)], np.array([[0.5]]), np.array([[0.0]]))


def test_a_chunk_tells_three_numbers_a_setting_however_many_cuts(spark, rows):
    for points in (3, 400):
        latches = sweep.Latches.of(DWELLS, np.linspace(0.01, 0.99, points)[None], np.zeros((len(DWELLS), 1)))
        edges = sweep._edges(sweep.chunked(frame(spark, rows), DWELLS), latches).where("stay_id IS NOT NULL").collect()
        assert edges and {len(e["edge"]) for e in edges} == {3 * 4 * len(DWELLS)}
        assert len({(e["stay_id"], e["chunk"]) for e in edges}) == len(edges)


def test_what_a_reading_tells_against_the_definition():
    rng = random.Random(11)
    starts, t, p = np.array([0, 40, 41]), [], []
    for size in (40, 1, 79):
        now = 28_000_000.0 + rng.random()
        for _ in range(size):
            now += rng.choice([1 / 3, 5.0, 30.0, 59.9, 300.0])
            t.append(now)
            p.append(rng.choice([rng.random(), 0.5, 0.9, float("nan")] if rng.random() < 0.2 else [0.8, 0.1, rng.random()]))
    t, p, cuts = np.array(t), np.array(p), np.linspace(0.05, 0.95, 19)[None]
    latches = sweep.Latches.of(DWELLS, cuts, np.array([[0.0], [0.1], [0.0], [0.3]]))
    on, off = latches.told(t, p, starts)
    for i, dwell in enumerate(DWELLS):
        for j in range(cuts.shape[1]):
            for k in range(len(t)):
                begin, ups, up, down = max(s for s in starts if s <= k), 0, None, None
                for m in range(begin, k + 1):
                    if m > begin and t[m] - t[m - 1] > latches.max_gap:
                        ups, up, down = 0, None, None
                    ups, up = (ups + 1, t[m] if up is None else up) if p[m] > cuts[0, j] else (0, None)
                    down = (t[m] if down is None else down) if p[m] < latches.floors[i, j] else None
                switched_on = up is not None and t[k] - up >= dwell.promote_min and ups >= dwell.promote_readings
                assert (j < on[i, k]) == switched_on
                assert (j >= off[i, k]) == (down is not None and t[k] - down >= dwell.demote_min)


def test_portions_hold_whole_groups(monkeypatch):
    monkeypatch.setattr(sweep, "PORTION", 7)
    stay, chunk = [1] * 5 + [1] * 20 + [2] * 2 + [3] * 9, [0] * 5 + [1] * 20 + [1] * 11
    table = pa.table({"stay_id": stay, "chunk": chunk, "v": list(range(36))})
    got = list(sweep._portions(iter(table.to_batches(max_chunksize=4)), "stay_id", "chunk"))
    assert len(got) > 1 and [v for _, rows, _ in got for v in rows["v"].tolist()] == list(range(36))
    firsts = [int(rows["v"][s]) for starts, rows, _ in got for s in starts]
    assert firsts == [0, 5, 25, 27]
