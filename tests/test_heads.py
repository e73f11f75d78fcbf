"""Heads: fits on a fixture whose answer is known, and comparisons against loops."""

from __future__ import annotations

import random

import pytest

from ventide.operators import bootstrap, heads


@pytest.fixture(scope="module")
def scored(spark):
    """600 rows of 30 patients: `good` follows the label, `noise` does not, `holes` is not always known."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        good = round(min(max(0.3 + 0.3 * y + rng.gauss(0, 0.2), 0.0), 1.0), 3)
        rows.append((i % 30, float(y), good, round(rng.random(), 3), None if i % 10 == 0 else 0.5))
    rows.append((1, None, 0.5, 0.5, 0.5))
    rows.append((2, 1.0, float("nan"), 0.5, 0.5))
    return spark.createDataFrame(rows, "subject_id int, y double, good double, noise double, holes double")


NAMES = ("good", "noise", "holes")


def test_only_rows_that_every_head_scored_are_judged(scored):
    rows = heads.frame(scored, NAMES, "subject_id")
    assert rows.count() == 540
    assert {len(r["scores"]) for r in rows.collect()} == {3}
    table = {r["head"]: r for r in heads.head_metrics(rows, NAMES).collect()}
    assert {r["rows"] for r in table.values()} == {540}
    assert table["good"]["auc"] > 0.8 and abs(table["noise"]["auc"] - 0.5) < 0.1
    assert table["holes"]["auc"] == 0.5 and table["holes"]["mean_predicted"] == 0.5
    base = table["good"]["positive_rate"]
    assert table["good"]["brier_skill"] == pytest.approx(1 - table["good"]["brier"] / (base * (1 - base)))


def test_differences_are_paired_on_the_same_patients(scored):
    rows = heads.frame(scored, NAMES, "subject_id")
    found = heads.head_replicates(rows, NAMES, "subject_id", n=40)
    assert found.count() == 3 * 40 * len(bootstrap.METRICS)
    value = {(r["head"], r["rep"], r["metric"]): r["value"] for r in found.collect()}
    got = {(r["head"], r["metric"]): r for r in heads.head_differences(found, "good").collect()}
    assert {h for h, _ in got} == {"noise", "holes"}
    for (head, metric), r in got.items():
        sign = 1 if bootstrap.METRICS[metric] else -1
        gains = [sign * (value["good", k, metric] - value[head, k, metric]) for k in range(40)]
        assert r["mean"] == pytest.approx(sum(gains) / 40)
        assert r["p_worse"] == pytest.approx(sum(g <= 0 for g in gains) / 40)
        assert r["lo"] <= r["mean"] <= r["hi"] and r["resamples"] == 40
    assert got["noise", "auc"]["lo"] > 0.1 and got["noise", "auc"]["p_worse"] == 0
    # Against itself under another name nothing differs.
    twice = found.where("head = 'good'").selectExpr("'copy' AS head", "rep", "metric", "value").unionByName(
        found.where("head = 'good'"))
    same = heads.head_differences(twice, "good").collect()
    assert {(r["mean"], r["lo"], r["hi"]) for r in same} == {(0.0, 0.0, 0.0)}


def test_documentation_shares_stand_over_each_floor(spark):
    table = spark.createDataFrame(
        [("weighted", 0.25, 0.65, 0.9, 0.1), ("platt", 0.25, 0.65, 0.9, 0.5), ("documentation", 0.25, 0.35, 0.6, 0.2)],
        "head string, positive_rate double, ap double, auc double, brier_skill double")
    row = heads.documentation_shares(table).first()
    assert [round(x, 9) for x in row] == [0.25, 0.25, 0.4]
    level = table.selectExpr("head", "positive_rate", "positive_rate AS ap", "0.5D AS auc", "0.0D AS brier_skill")
    assert list(heads.documentation_shares(level).first()) == [None, None, None]
    assert list(heads.documentation_shares(table.where("head = 'none'")).first()) == [None, None, None]


def test_all_heads_are_fitted_and_scored_on_test_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        x, charted = rng.random(), float(rng.random() < 0.5)
        y = float(rng.random() < 0.02 + 0.25 * (x > 0.6) + 0.1 * charted)  # rare, as in practice
        patient = i % 90
        test = patient % 5 == 0
        fold = -1 if test else patient // 5 % 5
        rows.append((patient, i, "test" if test else "train", fold, y if i % 50 else None, x if i % 7 else None, charted,
                     rng.choice("ab"), "2020-01-01"))
    df = spark.createDataFrame(rows, "subject_id int, stay_id int, split string, fold int, y double, x double,"
                                     " charted_x double, unit string, charttime string")
    out = heads.fit_heads(df, ["x", "charted_x"], ["charted_x"], ["unit"], maxIter=4, maxDepth=2).collect()
    expected = [r for r in rows if r[2] == "test" and r[4] is not None]
    assert sorted(r["stay_id"] for r in out) == sorted(r[1] for r in expected)
    assert list(out[0].asDict()) == ["subject_id", "stay_id", "charttime", "y", *heads.HEADS]
    for r in out:
        assert all(0.0 <= r[h] <= 1.0 for h in heads.HEADS)
    ranked = lambda h: [r["stay_id"] for r in sorted(out, key=lambda r: (round(r[h], 12), r["stay_id"]))]
    assert ranked("platt") == ranked("weighted")  # a monotone map cannot change the ranking
    mean = lambda h: sum(r[h] for r in out) / len(out)
    rate = sum(r["y"] for r in out) / len(out)
    assert abs(mean("platt") - rate) < 0.1 < mean("weighted") - rate  # the weights lift the level
    assert len({round(r["documentation"], 9) for r in out}) == 2  # it sees one flag only
