"""Clinical rules on the edge cases they were written for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions import timefn
from ventide.operators import clean, cohort, comorbidity, impute, labels, pivot, split, static

T0 = dt.datetime(2024, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


def wide_frame(spark, rows):
    """rows: (stay, minute, {param: value})."""
    data = [
        (s, s, at(m), *[float(v[p]) if p in v else None for p in C.PARAMS], 0) for s, m, v in rows
    ]
    columns = ", ".join(f"{p} double" for p in C.PARAMS)
    return spark.createDataFrame(
        data, f"stay_id int, subject_id int, charttime timestamp, {columns}, warning tinyint")


def test_boundary_and_complete_units(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:59:00' AS a, timestamp'2024-01-01 01:01:00' AS b")
    row = df.select(timefn.boundary_diff("hour", F.col("a"), F.col("b")).alias("x"),
                    timefn.elapsed_whole_hours(F.col("a"), F.col("b")).alias("y")).first()
    assert (row.x, row.y) == (1, 0)


def test_pivot_rules(spark):
    events = [
        (1, 10, 223835, 0.5), (1, 10, 223835, 50.0), (1, 10, 220277, 150.0), (1, 10, 220277, 90.0),
        (1, 20, 220339, 5.0), (1, 20, 224700, 7.0), (1, 30, 220339, 6.0), (1, 40, 224695, 999.0),
        (1, 500, 220277, 95.0),
    ]
    log = spark.createDataFrame(
        [(s, s, s, at(m), i, v, None, 0) for s, m, i, v in events],
        "stay_id int, subject_id int, hadm_id int, charttime timestamp, itemid int,"
        " valuenum double, value string, warning tinyint")
    window = spark.createDataFrame([(1, at(0), at(100))],
                                   "stay_id int, vent_start timestamp, vent_end timestamp")
    got = {r.charttime: r for r in pivot.events_to_wide(log, window).collect()}
    assert set(got) == {at(10), at(20), at(30)}      # all-null and out-of-window rows are gone
    assert got[at(10)].fio2 == 50.0 and got[at(10)].spo2 == 90.0
    assert got[at(20)].peep == 7.0 and got[at(30)].peep == 6.0


def test_carry_forward_limit(spark):
    rows = [(1, 0, {"spo2": 90}), (1, 240, {"peep": 5}), (1, 241, {"peep": 6}), (2, 0, {"peep": 1})]
    wide = wide_frame(spark, rows)
    for width in (3600, 86400):
        out = impute.locf_companions(wide, {"spo2": 97.0}, width_s=width)
        got = {(r.stay_id, r.charttime): r for r in out.collect()}
        assert got[(1, at(240))].spo2_locf == 90.0
        assert got[(1, at(241))].spo2_locf is None
        assert got[(1, at(241))].spo2_final == 97.0
        assert got[(1, at(241))].spo2_delta_t_min == 241.0
        assert got[(1, at(0))].peep_structurally_missing_in_stay == 0
        assert got[(2, at(0))].spo2_structurally_missing_in_stay == 1
    causal = impute.locf_companions(wide, {}, causal=True)
    first = causal.where("stay_id = 1").orderBy("charttime").first()
    assert first.peep_structurally_missing_in_stay == 1


def make_labels(spark, rows, pressor=(), width=86400):
    wide = wide_frame(spark, rows)
    carried = impute.locf_companions(wide, {}, width_s=width)
    on = set(pressor)
    drug = spark.createDataFrame([(s, at(m), int((s, m) in on)) for s, m, _ in rows],
                                 "stay_id int, charttime timestamp, vasopressor_running int")
    out = labels.forward_labels(carried, drug, width_s=width)
    return {(r.stay_id, int((r.charttime - T0).total_seconds() // 60)): r for r in out.collect()}


def test_label_window_and_censoring(spark):
    rows = [(1, 0, {"spo2": 95}), (1, 360, {"spo2": 80}), (1, 400, {"spo2": 95}),
            (2, 0, {"spo2": 95}), (2, 361, {"spo2": 80})]
    for width in (43_200, 86_400):
        got = make_labels(spark, rows, width=width)
        assert got[(1, 0)].y_resp_6h == 1                   # an event exactly at t + 6 h counts
        assert got[(2, 0)].y_resp_6h == 0                   # one minute later does not
        assert got[(1, 360)].y_resp_6h is None              # its own value is not ahead of it
        assert got[(1, 400)].y_resp_6h is None              # last row of the stay


def test_label_needs_a_lasting_rise(spark):
    spike = [(1, 0, {"fio2": 40}), (1, 10, {"fio2": 100}), (1, 20, {"fio2": 40}), (1, 900, {"spo2": 99})]
    held = [(2, 0, {"fio2": 40}), (2, 10, {"fio2": 60}), (2, 20, {"fio2": 65}), (2, 900, {"spo2": 99})]
    got = make_labels(spark, spike + held)
    assert got[(1, 0)].y_resp_6h == 0
    assert got[(2, 0)].y_resp_6h == 1


@pytest.mark.parametrize("gap,expected", [(359, 0), (360, 1)])
def test_pressor_restart(spark, gap, expected):
    rows = [(1, 0, {"spo2": 99}), (1, 1, {"spo2": 99}), (1, gap, {"spo2": 99}), (1, 900, {"spo2": 99})]
    got = make_labels(spark, rows, pressor=[(1, 0), (1, gap)])
    assert got[(1, 1)].y_circ_6h == expected


def test_label_identities(spark):
    import random
    rng = random.Random(4)
    rows = [(s, m, {p: rng.randint(0, 120) for p in ("spo2", "fio2", "peep") if rng.random() < 0.5})
            for s in (1, 2) for m in sorted(rng.sample(range(2000), 60))]
    got = make_labels(spark, rows, pressor=[(s, m) for s, m, _ in rows if rng.random() < 0.2])
    for r in got.values():
        for h in (2, 6, 12):
            assert (r[f"y_composite_{h}h"] == 1) == (r[f"y_resp_{h}h"] == 1 or r[f"y_circ_{h}h"] == 1)
            assert r[f"y_strict_{h}h"] != 1 or r[f"y_composite_{h}h"] == 1
        assert r["y_resp_2h"] != 1 or r["y_resp_6h"] == 1


def test_charlson(spark):
    assert comorbidity.expand("430-432 V43 I60-I61") == ["430", "431", "432", "V43", "I60", "I61"]
    rows = [(1, 10, "k70.4"), (1, 10, "B18"), (2, 9, "410 "), (2, 10, "E112"), (3, 9, "x"), (4, 10, "410")]
    df = spark.createDataFrame(rows, "hadm_id bigint, icd_version int, icd_code string")
    out = comorbidity.category_flags(df, strip_dots=True).withColumns(
        {"s": comorbidity.score(), "flat": comorbidity.score(False)})
    got = {r.hadm_id: r for r in out.collect()}
    assert (got[1].s, got[1].flat) == (3, 4)            # the milder liver grade counts once
    assert got[2].cci_myocardial_infarction == 1 and got[2].s == 3
    assert got[3].s == 0 and got[4].s == 0              # ICD-9 codes do not match under ICD-10
    undotted = comorbidity.category_flags(df).where("hadm_id = 1").first()
    assert undotted.cci_severe_liver_disease == 0
    ages = spark.createDataFrame([(50,), (51,), (80,), (81,), (None,)], "a int")
    assert [r[0] for r in ages.select(comorbidity.age_points(F.col("a"))).collect()] == [0, 1, 3, 4, 0]


def test_cohort_union(spark):
    stays = spark.createDataFrame(
        [(1, 1, i, "A", "B", T0, at(600), 1.0) for i in (1, 2, 3)],
        "subject_id int, hadm_id int, stay_id int, first_careunit string, last_careunit string,"
        " intime timestamp, outtime timestamp, los double")
    procedures = spark.createDataFrame(
        [(1, C.ITEM_INVASIVE_VENT, at(0), at(90)), (2, C.ITEM_INVASIVE_VENT, at(0), None)],
        "stay_id int, itemid int, starttime timestamp, endtime timestamp")
    events = spark.createDataFrame(
        [(s, 1, 1, at(m), i, None, v, 0) for s, m, i, v in [
            (2, 5, C.ITEM_VENT_MODE, "x"), (2, 65, C.ITEM_VENT_MODE, "x"),
            (3, 5, C.ITEM_PEEP_SET, None), (3, 65, C.ITEM_PEEP_SET, None)]],
        "stay_id int, subject_id int, hadm_id int, charttime timestamp, itemid int,"
        " valuenum double, value string, warning tinyint")
    strict = cohort.strict_cohort(stays, procedures)
    both = cohort.union_cohort(strict, cohort.ventilation_evidence(events), stays)
    got = {r.stay_id: (r.cohort_source, r.vent_hours, r.first_careunit) for r in both.collect()}
    assert got == {1: ("strict", 1, "A"), 2: ("evidence", 1, "A")}   # PEEP alone never admits


def test_split_is_patient_grouped(spark):
    rows = [(s, s // 2, 1 if s % 10 == 0 else 0) for s in range(400) for _ in range(3)]
    df = spark.createDataFrame(rows, "stay_id int, subject_id int, warning int")
    out = split.patient_split(df)
    split.require_disjoint(out)
    got = out.collect()
    assert len(got) == 200
    assert all((r.fold == -1) == (r.split == "test") for r in got)
    never = [r for r in got if r.n_pos == 0]
    assert sum(r.split == "test" for r in never) == -(-len(never) // 5)
    assert {r.fold for r in got if r.split == "train"} == {0, 1, 2, 3, 4}


def test_balanced_sample_is_exact(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "i int, y int")
    counts = {r.y: r["count"] for r in split.balanced_sample(df, "y", ["i"]).groupBy("y").count().collect()}
    assert counts == {0: 100, 1: 100}
    assert split.balanced_sample(df, "y", ["i"], 50).count() == 50


def test_body_weight(spark):
    df = spark.createDataFrame([(177.8, "M"), (177.8, "F"), (None, "M"), (177.8, None)],
                               "h double, g string")
    got = [r[0] for r in df.select(static.predicted_body_weight(F.col("h"), F.col("g"))).collect()]
    assert got[0] == pytest.approx(73.0) and got[1] == pytest.approx(68.5) and got[2:] == [None, None]


def test_plausible_range_is_not_clipped(spark):
    df = spark.createDataFrame([(20.9,), (21.0,), (1.0,), (0.0,), (101.0,)], "v double")
    got = [r[0] for r in df.select(clean.plausible_value("fio2", C.ITEM_FIO2, F.col("v"))).collect()]
    assert got == [None, 21.0, 100.0, None, None]
