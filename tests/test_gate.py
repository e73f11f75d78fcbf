"""Gate: the rule, the chain with its reverts, measures against loops, and fits on one row set."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from ventide import config as C
from ventide.operators import gate, heads
from ventide.plans import gate as plan

BASE = gate.Measured(rows=100, positive_rate=0.2, ap_full=0.5, ap_documentation=0.3, auc_full=0.8, auc_documentation=0.6,
                     ap_skill=0.375, doc_share=0.3, d_ap=0.2, d_ap_lo=0.15, d_ap_hi=0.25, d_auc=0.2, d_auc_lo=0.15, d_auc_hi=0.25)


def test_a_fall_inside_the_interval_is_noise_and_beyond_it_a_loss():
    assert gate.compare(BASE, BASE) == ("held", "held", "held")
    assert gate.compare(replace(BASE, d_ap=0.18, d_ap_hi=0.2), BASE) == ("noise", "held", "held")
    assert gate.compare(replace(BASE, d_ap=0.18, d_ap_hi=0.199), BASE) == ("worse", "held", "held")
    assert gate.compare(replace(BASE, d_auc=0.1, d_auc_hi=0.19), BASE) == ("held", "worse", "held")
    assert gate.compare(replace(BASE, doc_share=0.31), BASE) == ("held", "held", "held")  # the tolerance itself
    assert gate.compare(replace(BASE, doc_share=0.3101), BASE) == ("held", "held", "worse")
    # The level of AP alone decides nothing.
    assert gate.compare(replace(BASE, ap_full=0.1, auc_full=0.5), BASE) == ("held", "held", "held")


def test_a_rejected_change_is_not_in_the_states_after_it():
    seen = []

    def measured(changes):
        seen.append(dict(changes))
        return replace(BASE, d_ap=0.2 + 0.05 * changes.get("good", 0), d_ap_hi=0.25, d_auc=0.1 if changes.get("bad") else 0.2,
                       d_auc_hi=0.15 if changes.get("bad") else 0.25)

    steps = [("start", {"good": 0}), ("worsens", {"bad": 1}), ("helps", {"good": 1}), ("neutral", {"other": 1})]
    trials = gate.run(steps, measured)
    assert seen == [{"good": 0}, {"good": 0, "bad": 1}, {"good": 1}, {"good": 1, "other": 1}]
    assert [(t.step, t.built_on, t.decision) for t in trials] == [
        ("start", "", "baseline"), ("worsens", "start", "reject"), ("helps", "start", "accept"), ("neutral", "helps", "accept")]
    assert gate.run([], measured) == []


def test_the_table_keeps_order_and_numbers(spark):
    trials = gate.run([("a", {}), ("b", {})], lambda changes: BASE)
    rows = gate.as_table(spark, trials).orderBy("place").collect()
    assert [(r["step"], r["built_on"], r["rows"], r["d_auc_hi"]) for r in rows] == [("a", "", 100, 0.25), ("b", "a", 100, 0.25)]
    assert gate.as_table(spark, []).count() == 0


def test_steps_name_settings_and_end_at_the_present_build():
    state = {}
    for _, changes in plan.STEPS:
        state |= changes
        plan.settings_of(state)
    assert plan.settings_of(state) == C.Settings()
    with pytest.raises(ValueError, match="colour"):
        plan.settings_of({"colour": 1})


def average_precision(pairs):
    ranked, hits, total = sorted(pairs, key=lambda x: -x[0]), 0, 0.0
    for score in sorted({p for p, _ in pairs}, reverse=True):
        tied = [y for p, y in ranked if p == score]
        hits += sum(tied)
        total += sum(tied) * hits / sum(1 for p, _ in ranked if p >= score)
    return total / sum(y for _, y in pairs)


def test_measures_against_loops(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        y = float(rng.random() < 0.3)
        rows.append((i % 25, y, round(0.3 * y + rng.random(), 2), round(rng.random() + 0.1 * y, 2)))
    rows += [(1, 1.0, None, 0.5), (1, None, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "subject_id int, y double, full double, documentation double")
    got = gate.measure(heads.frame(df, gate.NAMES, "subject_id"), "subject_id", n=60)
    known = rows[:400]
    rate = sum(r[1] for r in known) / 400
    full, doc = (average_precision([(r[k], r[1]) for r in known]) for k in (2, 3))
    assert got.rows == 400 and got.positive_rate == pytest.approx(rate)
    assert (got.ap_full, got.ap_documentation) == pytest.approx((full, doc))
    assert got.ap_skill == pytest.approx((full - rate) / (1 - rate))
    assert got.doc_share == pytest.approx((doc - rate) / (full - rate), abs=1e-8)
    assert got.d_ap_lo < got.d_ap < got.d_ap_hi and abs(got.d_ap - (full - doc)) < 0.05
    with pytest.raises(ValueError, match="both labels"):
        gate.measure(heads.frame(df.where("y = 1"), gate.NAMES, "subject_id"), "subject_id", n=5)


def test_both_fits_score_the_same_test_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(800):
        x, charted = rng.random(), float(rng.random() < 0.5)
        patient = i % 80
        test = patient % 5 == 0
        y = float(rng.random() < 0.05 + 0.6 * (x > 0.6) + 0.1 * charted)
        rows.append((patient, "test" if test else "train", -1 if test else patient // 5 % 5, y if i % 40 else None,
                     x if i % 9 else None, charted, rng.choice("ab")))
    df = spark.createDataFrame(rows, "subject_id int, split string, fold int, y double, x double, charted_x double, unit string")
    found = gate.fit_pair(df, ["x", "charted_x"], ["charted_x"], ["unit"], maxIter=4, maxDepth=2)
    assert found.count() == sum(r[1] == "test" and r[3] is not None for r in rows)
    got = gate.measure(found, "subject_id", n=40)
    assert got.auc_full > 0.7 > got.auc_documentation and got.d_auc_lo > 0
