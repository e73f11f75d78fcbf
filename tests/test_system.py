"""Sources, sinks, streams and the registered queries."""

import datetime as dt
import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ventide import config as C
from ventide.operators.bands import Dwell, Machine
from ventide.plans.sources_sql import with_sources
from ventide.sources import io
from ventide.sources import testdata as TD
from ventide.sources.schemas import TABLES, schema
from ventide.streaming import processors as P
from ventide.session import shared_folder, stage

SMALL = entry.SMALL
T0 = dt.datetime(2024, 1, 1)


def test_csv_with_doubled_quotes(spark, tmp_path):
    folder = tmp_path / "icu" / "d_items.csv.gz"
    folder.mkdir(parents=True)
    with gzip.open(folder / "d_items.csv.gz", "wt") as fh:
        fh.write('itemid,label,linksto\n1,"a ""quoted"", label",inputevents\n2,,chartevents\n')
    rows = io.read_table(spark, str(tmp_path), "d_items").collect()
    assert [(r.itemid, r.label) for r in rows] == [(1, 'a "quoted", label'), (2, None)]
    with pytest.raises(FileNotFoundError) as error:
        io.require_tables(spark, str(tmp_path))
    assert all(t in str(error.value) for t in TABLES if t != "d_items")


def test_charted_values_are_rounded_as_in_the_sql(spark, tmp_path):
    rows = [(i, T0, i, "click", v, '{"k": 20}') for i, v in enumerate((14.5, 28.5, 56.5, 57.5, 157.5, 50.5, 7.25))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.stay_id: r.valuenum for r in TD.chartevents(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = dict(con.execute(with_sources(["chartevents"], {}, "SELECT stay_id, valuenum FROM chartevents")).fetchall())
    assert got == want and got[1] == 0.28


def test_sorted_parquet_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, i, None if i % 3 else i) for i in range(50)], "a int, b int, c int")
    io.write_sorted(df, str(tmp_path / "p"), ["a", "b"], 3)
    assert io.read_parquet(spark, str(tmp_path / "p"), ["a"]).count() == 50
    nested = df.select("a", F.struct("b", "c").alias("s"))
    io.write_json_lines(nested, str(tmp_path / "j"))
    back = io.read_json_lines(spark, str(tmp_path / "j"), nested.schema)
    assert sorted(back.collect()) == sorted(nested.collect())
    text = spark.read.text(str(tmp_path / "j")).where("value LIKE '%null%'").count()
    assert text > 0                                   # null fields are written, not dropped


def test_manifest_skips_and_cleans_up(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)
    build = lambda: spark.read.parquet(source).write.mode("overwrite").parquet(output)
    settings = C.Settings()
    assert io.run_stage(spark, "s", [source], output, settings.fingerprint(), build)
    assert not io.run_stage(spark, "s", [source], output, settings.fingerprint(), build)
    other = C.Settings(flags=C.Flags(causal=True)).fingerprint()
    assert other != settings.fingerprint()

    def fail():
        build()
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        io.run_stage(spark, "s", [source], output, other, fail)
    assert not io.exists(spark, output)


def test_stage_reports_failure():
    lines = []
    with pytest.raises(ZeroDivisionError), stage("x", lines.append):
        1 / 0
    assert "failed" in lines[-1]


def test_stream_rejects_what_it_cannot_apply(spark):
    root = shared_folder(spark, "test")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    row = lambda s, m, v: (s, at(m), at(0), True, None,
                           *[v if p == "spo2" else None for p in C.PARAMS])
    portions = [[row(1, 10, 90.0), row(1, -5, 80.0), row(2, 5, 70.0)],
                [row(1, 5, 60.0), row(1, 20, None), (1, at(15), at(0), False, "PSV", *[None] * 11)]]
    for rows in portions:
        spark.createDataFrame(rows, P.READING_SCHEMA).write.mode("append").parquet(f"{root}/in")
        stream = P.feature_stream(P.read_stream(spark, f"{root}/in", P.READING_SCHEMA), {"spo2": 1.0})
        P.run_available(stream, f"{root}/out", f"{root}/state")
    good, bad = P.split_results(spark.read.parquet(f"{root}/out"))
    assert sorted((r.stay_id, r.rejected) for r in bad.collect()) == [
        (1, "before ventilation"), (1, "reading out of order")]
    last = good.where(F.col("charttime") == F.lit(at(20))).first()
    assert (last.spo2_locf, last.spo2_delta_t_min) == (90.0, 10.0)     # state survived the restart
    assert (last.ventilator_mode, last.ventilator_mode_age_min) == ("PSV", 5.0)


def test_band_processor_state_is_json():
    import json
    m = P.BandProcessor(Machine((0.3, 0.5, 0.7), Dwell(0.0, 1, 0.0, 0.0)))
    import pandas as pd
    state = json.loads(json.dumps(m.fresh))
    out = m.step(state, {"stay_id": 1, "charttime": pd.Timestamp(T0), "p": 0.6})
    state = json.loads(json.dumps(state))
    out = m.step(state, {"stay_id": 1, "charttime": pd.Timestamp(T0) + pd.Timedelta(minutes=5), "p": 0.6})
    assert (out["displayed"], out["readings_in_state"]) == ("HIGH", 2)


def test_processor_steps_through_rows_without_a_frame_per_stay():
    from pyspark.sql import Row
    kept = []

    class Store:
        exists = staticmethod(lambda: bool(kept))
        get = staticmethod(lambda: kept[-1])
        update = staticmethod(kept.append)

    m = P.BandProcessor(Machine((0.3, 0.5, 0.7), Dwell(0.0, 1, 0.0, 0.0)))
    m._store = Store
    us = lambda minute: 1_704_067_200_000_000 + minute * 60_000_000
    rows = [Row(stay_id=1, charttime=us(5), p=None), Row(stay_id=1, charttime=us(0), p=0.6)]
    out = list(m.handleInputRows((1,), iter(rows), None))
    assert [(r.charttime, r.displayed, r.instant) for r in out] == [(us(0), "HIGH", "HIGH"), (us(5), "HIGH", "LOW")]
    late = list(m.handleInputRows((1,), iter([Row(stay_id=1, charttime=us(3), p=0.6)]), None))
    assert [r.rejected for r in late] == ["reading out of order"] and len(kept) == 2


def test_schema_text():
    assert schema("a int, b string").simpleString() == "struct<a:int,b:string>"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.label for r in rows} == {f"y_{v}_{h}h" for v in ("resp", "circ", "composite", "strict")
                                       for h in (2, 6, 12)}


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "cohort_union", "pivot_wide", "interval_drug_state", "asof_mode", "static_table", "outcomes",
    "rank_metrics", "reliability_bins", "bm25_topk", "dense_topk"])
def test_against_oracle(spark, name):
    from tools.check_oracle import TABLES as tables, rows_of
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())
