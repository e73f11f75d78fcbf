"""Drug state and ventilator mode at every reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.timefn import boundary_diff
from ventide.operators.joins import asof_before, interval_state
from ventide.operators.scan import DAY_SECONDS


def drug_map(d_items: DataFrame, flags: C.Flags = C.Flags()) -> DataFrame:
    """(group, itemid) for labels matching a group's pattern; an item may be in several."""
    label = F.lower("label")
    groups = F.array_compact(
        F.array(*[F.when(label.rlike(p), F.lit(g)) for g, p in flags.drug_patterns().items()])
    )
    return (
        d_items.where(F.col("linksto") == "inputevents")
        .select("itemid", F.explode(groups).alias("grp"))
    )


def require_groups(mapping: DataFrame, flags: C.Flags = C.Flags()) -> None:
    """An empty group would become an all-zero feature: refuse it."""
    found = {row["grp"] for row in mapping.select("grp").distinct().collect()}
    missing = sorted(set(flags.drug_patterns()) - found)
    if missing:
        raise ValueError(f"drug groups matched no items: {missing}")


def infusions(inputevents: DataFrame, mapping: DataFrame, readings: DataFrame) -> DataFrame:
    """Infusion intervals of stays that have readings, rewritten entries left out."""
    return (
        inputevents.where(F.col("stay_id").isNotNull() & F.col("starttime").isNotNull())
        .where(~F.col("statusdescription").eqNullSafe("Rewritten"))
        .join(mapping, "itemid")
        .join(readings.select("stay_id").distinct(), "stay_id", "left_semi")
        .select("stay_id", "grp", "starttime", "endtime",
                F.coalesce("rate", F.lit(0.0)).alias("rate"),
                F.coalesce("amount", F.lit(0.0)).alias("amount"))
    )


def drug_state(readings: DataFrame, intervals: DataFrame, flags: C.Flags = C.Flags(),
               width_s: int = DAY_SECONDS) -> DataFrame:
    return interval_state(
        readings.select("stay_id", "charttime"), intervals, "stay_id", "charttime", "grp",
        tuple(flags.drug_patterns()), "starttime", "endtime", "rate", width_s=width_s,
    )


def modes(events: DataFrame) -> DataFrame:
    """Charted ventilator modes, one per instant (the largest text on a tie)."""
    return (
        events.where((F.col("itemid") == C.ITEM_VENT_MODE) & F.col("value").isNotNull())
        .groupBy("stay_id", F.col("charttime").alias("mode_time"))
        .agg(F.max("value").alias("ventilator_mode"))
    )


def mode_state(readings: DataFrame, mode_events: DataFrame, width_s: int = DAY_SECONDS) -> DataFrame:
    """Last mode charted strictly before each reading, with its age in minutes or -1."""
    found = asof_before(readings, mode_events, ["stay_id"], "charttime", "mode_time",
                        ["ventilator_mode"], width_s=width_s)
    age = boundary_diff("minute", F.col("mode_time"), F.col("charttime"))
    return found.withColumn(
        "ventilator_mode_age_min", F.coalesce(age, F.lit(-1)).cast("double")
    ).drop("mode_time")


def interventions(readings: DataFrame, intervals: DataFrame, mode_events: DataFrame,
                  flags: C.Flags = C.Flags(), width_s: int = DAY_SECONDS) -> DataFrame:
    """Drug state and mode side by side, one row per reading."""
    drugs = drug_state(readings, intervals, flags, width_s)
    mode = mode_state(readings.select("stay_id", "charttime"), mode_events, width_s)
    return drugs.join(mode, ["stay_id", "charttime"])
