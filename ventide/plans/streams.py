"""Registered replays of the stream processors; their oracles are those of the batch form.

The readings arrive in two portions, each processed by its own run of the query, so the
second run works from restored state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators import impute, split
from ventide.plans import evaluation as EV
from ventide.plans import timeseries as TS
from ventide.plans.timeseries import minute, r
from ventide.session import materialize, shared_folder
from ventide.sources.io import read_parquet
from ventide.streaming import processors as P


def _replay(rows: DataFrame, schema, transform) -> DataFrame:
    spark = rows.sparkSession
    root = shared_folder(spark, "replay")
    source, output, state = f"{root}/in", f"{root}/out", f"{root}/state"
    span = rows.agg(F.min("charttime").alias("a"), F.max("charttime").alias("b")).first()
    middle = span["a"] + (span["b"] - span["a"]) / 2
    for part in (F.col("charttime") <= middle, F.col("charttime") > middle):
        rows.where(part).select(*schema.fieldNames()).write.mode("append").parquet(source)
        P.run_available(transform(P.read_stream(spark, source, schema)), output, state)
    return read_parquet(spark, output)


def q_stream_features(spark, sf):
    readings = materialize(TS.wide(spark, sf))
    reference = impute.reference_medians(readings, split.patient_split(readings))
    rows = readings.select(
        "stay_id", "charttime", F.lit(None).cast("timestamp").alias("vent_start"),
        F.lit(True).alias("is_reading"), F.lit(None).cast("string").alias("ventilator_mode"),
        *C.PARAMS)
    out = _replay(rows, P.READING_SCHEMA, lambda s: P.feature_stream(s, reference))
    return TS._companion_columns(P.split_results(out)[0])


def q_stream_modes(spark, sf):
    readings = materialize(TS.wide(spark, sf).select("stay_id", "charttime", *C.PARAMS))
    modes = TS.interventions.modes(TS.ts_long(spark, sf)).join(
        readings.select("stay_id").distinct(), "stay_id", "left_semi")
    empty = [F.lit(None).cast("double").alias(p) for p in C.PARAMS]
    began = F.lit(None).cast("timestamp").alias("vent_start")
    rows = readings.select(
        "stay_id", "charttime", began, F.lit(True).alias("is_reading"),
        F.lit(None).cast("string").alias("ventilator_mode"), *C.PARAMS,
    ).unionByName(modes.select(
        "stay_id", F.col("mode_time").alias("charttime"), began, F.lit(False).alias("is_reading"),
        "ventilator_mode", *empty))
    out = _replay(materialize(rows), P.READING_SCHEMA, lambda s: P.feature_stream(s, {}))
    return P.split_results(out)[0].select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(), "ventilator_mode",
        r("ventilator_mode_age_min"))


def q_stream_bands(spark, sf):
    rows = materialize(EV.readings(spark, sf).select(
        F.col("stay_id").cast("int").alias("stay_id"), "charttime", "p"))
    out = _replay(rows, P.SCORE_SCHEMA, lambda s: P.band_stream(s, EV.MACHINE))
    return P.split_results(out)[0].select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(), "instant", "displayed",
        "band_state", "readings_in_state")


QUERIES = {
    "stream_features": q_stream_features,
    "stream_modes": q_stream_modes,
    "stream_bands": q_stream_bands,
}
ORACLES = {
    "stream_features": TS.ORACLES["locf_causal"],
    "stream_modes": TS.ORACLES["asof_mode"],
    "stream_bands": EV.ORACLES["band_views"],
}
