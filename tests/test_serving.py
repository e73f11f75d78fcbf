"""The live feature row: open infusions in a stay's state, and rows held against what was frozen."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest

from ventide import config as C
from ventide.operators import serving
from ventide.sources.schemas import schema
from ventide.streaming import processors as P

START = datetime(2024, 1, 1)


def entry(minute, kind="reading", **more):
    base = dict.fromkeys(P.CHART_SCHEMA.fieldNames()) | {
        "stay_id": 1, "charttime": pd.Timestamp(START + timedelta(minutes=minute)), "vent_start": pd.Timestamp(START),
        "is_reading": kind == "reading"}
    return base | more


def infusion(start, end, rate, grp="vasopressor"):
    until = None if end is None else pd.Timestamp(START + timedelta(minutes=end))
    return entry(start, "infusion", grp=grp, endtime=until, rate=rate)


def run(rows):
    import copy

    processor, out = P.RowProcessor({"spo2": 95.0}), []
    state = copy.deepcopy(processor.fresh)
    for row in rows:
        got = processor.step(state, row)
        state = json.loads(json.dumps(state))  # what the store keeps between batches
        if got is not None:
            out.append(got)
    return out, state


def test_infusions_against_all_pairs():
    spans = [(0, 50, 1.0, "vasopressor"), (10, 30, 2.5, "vasopressor"), (10, 10, 9.0, "opioid"), (20, None, 5.0, "opioid"),
             (5, 200, None, "sedative"), (60, 61, 1.0, "vasopressor")]
    rows = sorted([infusion(*s) for s in spans] + [entry(t, spo2=90.0) for t in range(0, 90, 5)],
                  key=lambda r: (r["charttime"], not r["is_reading"]))
    out, state = run(rows)
    for row in out:
        now = (row["charttime"] - pd.Timestamp(START)) / pd.Timedelta(minutes=1)
        for g in C.DRUG_GROUPS:
            active = [s for s in spans if s[3] == g and s[1] is not None and s[0] < now < s[1]]
            assert row[f"{g}_running"] == bool(active)
            assert row[f"{g}_rate"] == sum(s[2] or 0.0 for s in active)
            assert row[f"{g}_minutes_since_start"] == (max(now - s[0] for s in active) if active else -1.0)
    assert [x[0] for x in state["open"]] == ["sedative"]  # what has ended is forgotten


def test_late_infusion_counts_from_the_next_reading():
    out, _ = run([entry(10, spo2=90.0), infusion(5, 40, 2.0), entry(20, spo2=91.0), entry(15, spo2=1.0)])
    assert [r["vasopressor_running"] for r in out] == [0, 1, None]
    assert out[2]["rejected"] == "reading out of order" and set(out[2]) == set(P.ROW_SCHEMA.fieldNames())


def static(spark, **more):
    row = {"stay_id": 1, "subject_id": 7, "hadm_id": 1, "vent_start": None, "vent_end": None, "vent_hours": 3,
           "leaky_dod": None, "gender": "M", "pbw_kg": 50.0} | more
    return spark.createDataFrame([row], "stay_id int, subject_id int, hadm_id int, vent_start timestamp, vent_end timestamp,"
                                        " vent_hours long, leaky_dod date, gender string, pbw_kg double")


def test_rows_are_held_against_the_assets(spark, tmp_path):
    layout = schema("stay_id int, charttime timestamp, rejected string, tidal_volume_observed_final double, vent_hours double")
    rows = spark.createDataFrame([(1, START, None, 400.0, 2.0), (2, START, None, 400.0, 2.0), (1, START, "late", None, None)], layout)
    features = ("pbw_kg", "gender", "vent_hours", "tidal_volume_observed_final", "tidal_volume_ml_per_kg_pbw")
    assets = serving.Assets(features, {"gender": ("F", "M")}, {"spo2": None}, {f: ("physiology", "static") for f in features}, "x")
    path = f"{tmp_path}/assets.json"
    assets.save(spark, path)
    assert serving.Assets.load(spark, path) == assets

    def told(table, with_assets=assets):
        got = serving.complete(rows, table, with_assets)
        assert got.columns == ["stay_id", "charttime", "rejected", *features]
        return {(r["stay_id"], r["rejected"]): r["tidal_volume_ml_per_kg_pbw"] for r in got.collect()}

    assert told(static(spark)) == {(1, None): 8.0, (2, "no static row"): None, (1, "late"): None}
    assert told(static(spark, gender="X"))[(1, "unknown gender: X")] is None
    assert told(static(spark, gender=None))[(1, None)] == 8.0
    with pytest.raises(ValueError, match="missing \\['height_cm'\\]"):
        serving.complete(rows, static(spark), serving.Assets((*features, "height_cm"), {}, {}, {}, "x"))
    with pytest.raises(ValueError, match="unexpected"):
        serving.complete(rows, static(spark), serving.Assets(features[1:], {}, {}, {}, "x"))


def test_identifiers_are_no_categories(spark):
    matrix = spark.createDataFrame([(str(i),) for i in range(5)], "gender string")
    man = {"categorical": ["gender"], "sets": {"full": ["gender"], "documentation": []}, "groups": {}, "fingerprint": "x"}
    assert serving.freeze(matrix, man, {}).levels == {"gender": ("0", "1", "2", "3", "4")}
    with pytest.raises(ValueError):
        serving.freeze(matrix, man, {}, most=4)
