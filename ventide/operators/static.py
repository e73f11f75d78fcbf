"""One row per stay: demographics, comorbidity, body size, and what is known afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.timefn import boundary_diff
from ventide.operators import comorbidity as CM
from ventide.operators.scan import DAY_SECONDS, Running, scan
from ventide.session import materialize


def body_metrics(events: DataFrame) -> DataFrame:
    """Earliest plausible height and weight of the stay, whatever item charted it.

    The earliest is an aggregate (smallest time, then value), so no stay is sorted.
    """
    columns = []
    for name, items, (lo, hi) in (
        ("height_cm", C.HEIGHT_ITEMS, C.HEIGHT_RANGE_CM),
        ("weight_kg", C.WEIGHT_ITEMS, C.WEIGHT_RANGE_KG),
    ):
        scaled = None
        for item, factor in items.items():
            here, v = F.col("itemid") == item, F.col("valuenum") * factor
            scaled = F.when(here, v) if scaled is None else scaled.when(here, v)
        valid = scaled.between(lo, hi)
        first = F.min_by(scaled, F.when(valid, F.struct(F.col("charttime"), scaled)))
        columns.append(first.alias(name))
    wanted = [*C.HEIGHT_ITEMS, *C.WEIGHT_ITEMS]
    found = events.where(F.col("itemid").isin(*wanted) & F.col("valuenum").isNotNull())
    return found.groupBy("stay_id").agg(*columns).dropna(
        how="all", subset=["height_cm", "weight_kg"]
    )


def predicted_body_weight(height_cm: Column, gender: Column) -> Column:
    over_five_feet = 2.3 * (height_cm / C.CM_PER_INCH - 60.0)
    return F.when(
        height_cm.isNotNull() & gender.isNotNull(),
        F.when(gender == "M", 50.0).otherwise(45.5) + over_five_feet,
    )


def visit_numbers(cohort: DataFrame, width_s: int = 30 * DAY_SECONDS) -> DataFrame:
    """Earlier stays of the same patient in the cohort; stays without a date come last."""
    dated = materialize(cohort.select("subject_id", "stay_id", F.coalesce(
        "intime", F.lit("9999-12-31").cast("timestamp")).alias("_visit")))
    counted = scan(
        dated, ["subject_id"], "_visit", {"_n": Running("sum", F.lit(1).cast("long"), strict=True)},
        tie=["stay_id"], width_s=width_s,
    )
    return cohort.join(
        counted.select("stay_id", F.coalesce("_n", F.lit(0)).alias("prior_icu_stays")), "stay_id")


def static_table(
    cohort: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    diagnoses: DataFrame,
    body: DataFrame,
    flags: C.Flags = C.Flags(),
) -> DataFrame:
    """Static features per stay; columns known only afterwards carry the leaky_ prefix.

    All right-hand sides have one row per key, so no join can multiply stays.
    """
    base = (
        visit_numbers(cohort)
        .join(patients, "subject_id", "left")
        .join(admissions, "hadm_id", "left")
        .join(CM.category_flags(diagnoses), "hadm_id", "left")
        .join(body, "stay_id", "left")
    )
    body_columns = (
        ["height_cm", "weight_kg",
         predicted_body_weight(F.col("height_cm"), F.col("gender")).alias("pbw_kg")]
        if flags.body_metrics
        else []
    )
    table = base.select(
        "stay_id", "subject_id", "hadm_id", "gender",
        (F.col("anchor_age") + F.year("intime") - F.col("anchor_year")).alias("age_at_icu"),
        "admission_type", "admission_location", "insurance", "language", "marital_status",
        "race", "first_careunit",
        boundary_diff("hour", F.col("admittime"), F.col("intime")).alias("hours_admit_to_icu"),
        boundary_diff("minute", F.col("edregtime"), F.col("edouttime")).alias("ed_minutes"),
        "prior_icu_stays",
        *[F.coalesce(f"cci_{n}", F.lit(0)).alias(f"cci_{n}") for n in CM.NAMES],
        *body_columns,
        F.col("intime").alias("leaky_icu_intime"),
        F.col("outtime").alias("leaky_icu_outtime"),
        F.col("los").alias("leaky_icu_los_days"),
        "vent_start", "vent_end", "vent_hours",
        F.col("admittime").alias("leaky_admittime"),
        F.col("dischtime").alias("leaky_dischtime"),
        F.col("deathtime").alias("leaky_deathtime"),
        F.col("discharge_location").alias("leaky_discharge_location"),
        F.col("hospital_expire_flag").alias("leaky_hospital_expire_flag"),
        F.col("dod").alias("leaky_dod"),
    )
    points = CM.age_points(F.col("age_at_icu"))
    weighted = CM.score(flags.charlson_hierarchy)
    return table.withColumns(
        {
            "charlson_comorbidity_score": weighted,
            "charlson_age_points": points,
            "charlson_index": weighted + points,
        }
    )


def outcomes(
    cohort: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    icustays: DataFrame,
    procedures: DataFrame,
) -> DataFrame:
    """Mortality, prolonged ventilation, reintubation and readmission per stay."""
    episodes = materialize(
        procedures.where((F.col("itemid") == C.ITEM_INVASIVE_VENT) & F.col("stay_id").isNotNull()
                         & F.col("starttime").isNotNull())
        .select("stay_id", "starttime", "endtime"))
    followed = scan(
        episodes, ["stay_id"], "starttime",
        {"_next": Running("last", F.col("starttime"), strict=True, reverse=True)},
        tie=["endtime"], width_s=30 * DAY_SECONDS,
    )
    gap = boundary_diff("hour", F.col("endtime"), F.col("_next"))
    reintubated = (
        followed.select("stay_id", gap.alias("gap"))
        .groupBy("stay_id")
        .agg(F.max(F.when(F.col("gap").between(0, C.REINTUBATION_WINDOW_H), 1).otherwise(0))
             .alias("extubation_failure"))
    )
    # A later stay of the same admission exists iff the admission's last start is later.
    last_start = icustays.groupBy("hadm_id").agg(F.max("intime").alias("last_intime"))
    readmitted = icustays.join(last_start, "hadm_id", "left").select(
        "stay_id",
        F.when(F.col("last_intime") > F.col("outtime"), 1).otherwise(0).alias("icu_readmission"),
    )
    death_day = lambda days: F.when(
        F.col("dod").isNotNull() & (F.datediff("dod", F.to_date("intime")) <= days), 1
    ).otherwise(0)
    joined = (
        cohort.join(admissions, "hadm_id", "left")
        .join(patients.select("subject_id", "dod"), "subject_id", "left")
        .join(reintubated, "stay_id", "left")
        .join(readmitted, "stay_id", "left")
    )
    in_icu = F.col("deathtime").between(F.col("intime"), F.coalesce("outtime", "dischtime"))
    flag = lambda c: F.coalesce(c, F.lit(0)).cast("byte")
    return joined.select(
        "stay_id", "subject_id", "hadm_id",
        flag(F.col("hospital_expire_flag")).alias("in_hospital_mortality"),
        F.when(in_icu, 1).otherwise(0).cast("byte").alias("icu_mortality"),
        death_day(28).cast("byte").alias("mortality_28d"),
        death_day(90).cast("byte").alias("mortality_90d"),
        F.when(F.col("vent_hours") > C.PROLONGED_VENT_H, 1).otherwise(0).cast("byte")
        .alias("prolonged_ventilation"),
        flag(F.col("extubation_failure")).alias("extubation_failure"),
        flag(F.col("icu_readmission")).alias("icu_readmission"),
        "vent_hours",
        F.col("los").alias("icu_los_days"),
    )
