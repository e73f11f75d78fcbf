"""Which stays are ventilated, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.timefn import boundary_diff


def strict_cohort(icustays: DataFrame, procedures: DataFrame) -> DataFrame:
    """Stays with an invasive-ventilation procedure: first start to last end."""
    spans = (
        procedures.where((F.col("itemid") == C.ITEM_INVASIVE_VENT) & F.col("stay_id").isNotNull())
        .groupBy("stay_id")
        .agg(
            F.min("starttime").alias("vent_start"),
            F.max(F.coalesce("endtime", "starttime")).alias("vent_end"),
            F.count(F.lit(1)).alias("n_vent_events"),
        )
        .where(F.col("vent_end") > F.col("vent_start"))
    )
    return icustays.join(spans, "stay_id").select(
        "subject_id", "hadm_id", "stay_id", "first_careunit", "last_careunit", "intime",
        "outtime", "los", "vent_start", "vent_end", "n_vent_events",
        boundary_diff("hour", F.col("vent_start"), F.col("vent_end")).alias("vent_hours"),
        F.lit("strict").alias("cohort_source"),
    )


def ventilation_evidence(events: DataFrame) -> DataFrame:
    """Charted signs of invasive ventilation per stay. PEEP is reported, it never admits."""
    item = F.col("itemid")
    flag = lambda condition: F.max(F.when(condition, 1).otherwise(0))
    return (
        events.where(item.isin(C.ITEM_VENT_MODE, C.ITEM_O2_DEVICE, C.ITEM_PEEP_SET))
        .groupBy("stay_id", "subject_id", "hadm_id")
        .agg(
            F.min("charttime").alias("ev_start"),
            F.max("charttime").alias("ev_end"),
            flag(item == C.ITEM_VENT_MODE).alias("has_vent_mode"),
            flag((item == C.ITEM_O2_DEVICE) & F.col("value").isin(*C.INVASIVE_DEVICES))
            .alias("has_airway"),
            flag(item == C.ITEM_PEEP_SET).alias("has_peep"),
        )
    )


def evidence_report(evidence: DataFrame, strict: DataFrame) -> DataFrame:
    """Stays per kind of evidence, and how many of them the strict cohort lacks."""
    known = strict.select("stay_id").distinct().withColumn("known", F.lit(True))
    mode, airway = F.col("has_vent_mode") == 1, F.col("has_airway") == 1
    kinds = F.filter(
        F.array(
            F.when(mode, F.lit("mode")), F.when(airway, F.lit("airway")),
            F.when(F.col("has_peep") == 1, F.lit("peep")),
            F.when(mode | airway, F.lit("admitting")),
        ),
        lambda k: k.isNotNull(),
    )
    return (
        evidence.join(known, "stay_id", "left")
        .select("known", F.explode(kinds).alias("evidence"))
        .groupBy("evidence")
        .agg(F.count(F.lit(1)).alias("stays"),
             F.count_if(F.col("known").isNull()).alias("not_in_strict"))
    )


def union_cohort(strict: DataFrame, evidence: DataFrame, icustays: DataFrame) -> DataFrame:
    """Strict stays plus stays with mode or airway evidence the procedure table missed."""
    found = (
        evidence.where((F.col("has_vent_mode") == 1) | (F.col("has_airway") == 1))
        .where(F.col("ev_end") > F.col("ev_start"))
        .join(strict.select("stay_id"), "stay_id", "left_anti")
        .select(
            "subject_id", "hadm_id", "stay_id",
            F.col("ev_start").alias("vent_start"),
            F.col("ev_end").alias("vent_end"),
            F.lit(0).cast("long").alias("n_vent_events"),
            boundary_diff("hour", F.col("ev_start"), F.col("ev_end")).alias("vent_hours"),
            F.lit("evidence").alias("cohort_source"),
        )
    )
    attributes = ["first_careunit", "last_careunit", "intime", "outtime", "los"]
    known = icustays.select("stay_id", *attributes)
    filled = found.join(known, "stay_id", "left")
    return strict.unionByName(filled, allowMissingColumns=True)
