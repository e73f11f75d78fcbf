"""Registered queries over the charted time series, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.timefn import micros
from ventide.operators import (
    assemble, clean, cohort, compare, impute, interventions, labels, pivot, split, static,
)
from ventide.plans.sources_sql import with_sources
from ventide.session import materialize
from ventide.sources import testdata as TD

RULES = C.LabelRules()


def minute(name: str = "charttime"):
    return F.floor(micros(F.col(name)) / F.lit(60_000_000)).cast("long").alias(name)


def r(name: str, digits: int = 4):
    return F.round(F.col(name).cast("double"), digits).alias(name)


# ------------------------------------------------------------------ stages
def ts_long(spark: SparkSession, sf: str) -> DataFrame:
    return clean.keep_items(TD.chartevents(spark, sf))


def user_stays(spark: SparkSession, sf: str) -> DataFrame:
    """Stays of the time series: one per user, dated by the user's events."""
    stay = TD.events(spark, sf).groupBy("stay_id").agg(
        F.min("charttime").alias("intime"), F.max("charttime").alias("outtime")
    )
    return stay.select(
        F.floor(F.col("stay_id") / 2).cast("int").alias("subject_id"),
        F.col("stay_id").cast("int").alias("hadm_id"),
        F.col("stay_id").cast("int").alias("stay_id"),
        F.concat(F.lit("U"), (F.col("stay_id") % 4).cast("string")).alias("first_careunit"),
        F.concat(F.lit("U"), (F.col("stay_id") % 3).cast("string")).alias("last_careunit"),
        "intime", "outtime",
        ((micros(F.col("outtime")) - micros(F.col("intime"))) / F.lit(86_400_000_000.0))
        .alias("los"),
    )


def final_cohort(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    stays = user_stays(spark, sf)
    strict = cohort.strict_cohort(stays, TD.procedures_of_users(spark, sf))
    evidence = cohort.ventilation_evidence(ts_long(spark, sf) if log is None else log)
    return cohort.union_cohort(strict, evidence, stays)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The one scan of the raw events is a stage of its own: cohort and pivot both read it."""
    log = materialize(ts_long(spark, sf))
    return pivot.events_to_wide(log, final_cohort(spark, sf, log))


def infusion_rows(spark: SparkSession, sf: str, readings: DataFrame, flags: C.Flags = C.Flags()) -> DataFrame:
    mapping = interventions.drug_map(TD.d_items(spark, sf), flags)
    return interventions.infusions(TD.inputevents(spark, sf), mapping, readings)


def imputed_of(readings: DataFrame, causal: bool = False) -> DataFrame:
    folds = split.patient_split(readings)
    return impute.locf_companions(readings, impute.reference_medians(readings, folds), causal)


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    readings = materialize(wide(spark, sf))
    drugs = interventions.drug_state(
        readings, materialize(infusion_rows(spark, sf, readings))
    ).select("stay_id", "charttime", "vasopressor_running")
    carried = impute.locf_companions(readings, {}).select(
        "stay_id", "charttime", "spo2", "fio2", "peep", "fio2_locf", "peep_locf",
        "fio2_delta_t_min", "peep_delta_t_min",
    )
    base = materialize(carried.join(drugs, ["stay_id", "charttime"], "left"))
    return labels.forward_labels(base.drop("vasopressor_running"), base, RULES)


# ------------------------------------------------------------------ queries
def q_item_extract(spark, sf):
    profile = ts_long(spark, sf).groupBy("itemid").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("stay_id").alias("stays"),
        F.count("valuenum").alias("with_value"),
    )
    return profile.orderBy(F.col("rows").desc(), "itemid")


def q_cohort_strict(spark, sf):
    out = cohort.strict_cohort(TD.icustays(spark, sf), TD.procedures_of_orders(spark, sf))
    return out.select(
        "stay_id", "subject_id", "hadm_id", minute("vent_start"), minute("vent_end"),
        "n_vent_events", F.col("vent_hours").cast("long").alias("vent_hours"), r("los"),
    )


def q_cohort_union(spark, sf):
    return final_cohort(spark, sf).select(
        F.col("stay_id").cast("long").alias("stay_id"), "first_careunit", minute("vent_start"),
        minute("vent_end"), "n_vent_events", F.col("vent_hours").cast("long").alias("vent_hours"),
        "cohort_source",
    )


def q_evidence_report(spark, sf):
    strict = cohort.strict_cohort(user_stays(spark, sf), TD.procedures_of_users(spark, sf))
    return cohort.evidence_report(cohort.ventilation_evidence(ts_long(spark, sf)), strict)


def q_plausibility(spark, sf):
    return clean.item_report(ts_long(spark, sf))


def q_pivot(spark, sf):
    return wide(spark, sf).select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(),
        *[r(p) for p in C.PARAMS], F.col("warning").cast("long").alias("warning"),
    )


def q_fill_rates(spark, sf):
    return pivot.fill_rates(wide(spark, sf)).select("parameter", "filled", "rows", r("pct_filled"))


def _companion_columns(df: DataFrame) -> DataFrame:
    columns = []
    for p in C.PARAMS:
        columns += [
            F.col(f"{p}_observed").cast("long").alias(f"{p}_observed"),
            r(f"{p}_delta_t_min"), r(f"{p}_locf"),
            F.col(f"{p}_structurally_missing_in_stay").cast("long")
            .alias(f"{p}_structurally_missing_in_stay"),
            r(f"{p}_final"),
        ]
    return df.select(F.col("stay_id").cast("long").alias("stay_id"), minute(), *columns)


def q_locf(spark, sf):
    return _companion_columns(imputed_of(materialize(wide(spark, sf))))


def q_locf_causal(spark, sf):
    return _companion_columns(imputed_of(materialize(wide(spark, sf)), causal=True))


def q_elapsed_in_stay(spark, sf):
    readings = materialize(wide(spark, sf).select("stay_id", "charttime"))
    return impute.elapsed_in_stay(readings).select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(), r("minutes_in_stay")
    )


def q_drug_state(spark, sf):
    readings = materialize(wide(spark, sf).select("stay_id", "charttime"))
    out = interventions.drug_state(readings, infusion_rows(spark, sf, readings))
    columns = []
    for g in C.DRUG_GROUPS:
        columns += [F.col(f"{g}_running").cast("long").alias(f"{g}_running"),
                    r(f"{g}_rate", 3), r(f"{g}_minutes_since_start")]
    return out.select(F.col("stay_id").cast("long").alias("stay_id"), minute(), *columns)


def q_mode_state(spark, sf):
    readings = materialize(wide(spark, sf).select("stay_id", "charttime"))
    out = interventions.mode_state(
        readings, materialize(interventions.modes(ts_long(spark, sf))))
    return out.select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(), "ventilator_mode",
        r("ventilator_mode_age_min"),
    )


def q_intervention_prevalence(spark, sf):
    readings = materialize(wide(spark, sf).select("stay_id", "charttime"))
    drugs = interventions.drug_state(readings, infusion_rows(spark, sf, readings))
    shares = drugs.agg(*[(100.0 * F.avg(f"{g}_running")).alias(g) for g in C.DRUG_GROUPS])
    return shares.unpivot([], list(C.DRUG_GROUPS), "grp", "pct_running").select(
        "grp", r("pct_running")
    )


def q_mode_values(spark, sf):
    """Readings per ventilator mode known to them; an empty mode stands for none."""
    readings = materialize(wide(spark, sf).select("stay_id", "charttime"))
    known = interventions.mode_state(readings, interventions.modes(ts_long(spark, sf)))
    return known.groupBy(F.coalesce("ventilator_mode", F.lit("")).alias("mode")).agg(
        F.count(F.lit(1)).alias("readings"))


def _label_output(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in ("stay_id", "charttime")]
    return df.select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(),
        *[F.col(c).cast("int").cast("long").alias(c) for c in names],
    )


def q_forward_labels(spark, sf):
    return _label_output(label_table(spark, sf))


def q_label_prevalence(spark, sf):
    return labels.prevalence(materialize(label_table(spark, sf)), RULES).select(
        "label", "rows", "rows_labelled", "positive", "stays_with_positive",
        r("positive_rate", 6),
    )


def q_vac(spark, sf):
    return labels.vac_days(wide(spark, sf)).select(
        F.col("stay_id").cast("long").alias("stay_id"), "n_days",
        F.col("vac").cast("long").alias("vac"),
    )


def q_hourly_forward(spark, sf):
    readings = materialize(wide(spark, sf))
    drugs = interventions.drug_state(readings, infusion_rows(spark, sf, readings))
    out = labels.hourly_forward(readings, drugs)
    return out.select(
        F.col("stay_id").cast("long").alias("stay_id"), minute("hr"),
        *[F.col(c).cast("long").alias(c) for c in ("escalation", "desaturation", "composite")],
    )


def q_body_metrics(spark, sf):
    return static.body_metrics(ts_long(spark, sf)).select(
        F.col("stay_id").cast("long").alias("stay_id"), r("height_cm"), r("weight_kg")
    )


def q_patient_summary(spark, sf):
    people = split.patient_summary(wide(spark, sf))
    return people.select(
        F.col("subject_id").cast("long").alias("subject_id"), "n_rows", "n_pos", "n_stays",
        split.stratum(F.col("n_pos") / F.col("n_rows")).cast("long").alias("strat"),
    )


def q_patient_split(spark, sf):
    people = split.patient_split(wide(spark, sf))
    return people.select(
        F.col("subject_id").cast("long").alias("subject_id"), "n_rows", "n_pos", "n_stays",
        F.col("strat").cast("long").alias("strat"), "split", F.col("fold").cast("long").alias("fold"),
    )


def q_sampled_stays(spark, sf):
    """A seeded draw of whole stays (the sampling operator itself)."""
    readings = wide(spark, sf).select(F.col("stay_id").cast("long").alias("stay_id"), minute())
    return split.sample_groups(readings, "stay_id", 25)


def q_stay_weights(spark, sf):
    readings = wide(spark, sf).select(F.col("stay_id").cast("long").alias("stay_id"), minute())
    return split.stay_weights(readings).select("stay_id", "charttime", r("weight", 6))


def static_of(spark: SparkSession, sf: str, stays: DataFrame, flags: C.Flags = C.Flags()) -> DataFrame:
    return static.static_table(
        stays, TD.patients(spark, sf), TD.admissions(spark, sf), TD.diagnoses(spark, sf),
        static.body_metrics(ts_long(spark, sf)), flags,
    )


def q_column_health(spark, sf):
    return assemble.column_health(wide(spark, sf), C.PARAMS)


def q_accounting(spark, sf):
    from ventide.sources.io import accounting

    return accounting(
        {"events": ts_long(spark, sf), "cohort": final_cohort(spark, sf), "wide": wide(spark, sf)},
        "stay_id", "subject_id",
    )


def q_missing_items(spark, sf):
    wanted = spark.createDataFrame([(i,) for i in C.CACHED_ITEMS], "itemid int")
    return compare.missing_values(wanted, ts_long(spark, sf), "itemid")


def q_agreement(spark, sf):
    """Medians against the plain averages of the same readings, per column."""
    readings = materialize(wide(spark, sf))
    events = pivot.events_in_window(ts_long(spark, sf), final_cohort(spark, sf))
    averages = events.groupBy("stay_id", "charttime").agg(
        *[
            F.coalesce(*[
                F.avg(F.when(F.col("itemid") == i, clean.plausible_value(p, i, F.col("valuenum"))))
                for i in items
            ]).alias(p)
            for p, items in C.PARAM_ITEMS.items()
        ]
    )
    return compare.agreement(readings, averages, ["stay_id", "charttime"], C.PARAMS).select(
        "column", "matched", "both", r("pct_within")
    )


def q_key_overlap(spark, sf):
    readings = wide(spark, sf)
    drugs = TD.inputevents(spark, sf).select(F.col("stay_id").cast("int").alias("stay_id"))
    return compare.key_overlap(readings, drugs, "stay_id")


def q_sliding_windows(spark, sf):
    readings = materialize(wide(spark, sf).select("stay_id", "charttime", F.coalesce(*C.PARAMS).alias("v")))
    out = impute.sliding_windows(readings, "v", length=10, stride=4)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return out.select(F.col("stay_id").cast("long").alias("stay_id"),
                      F.col("window").cast("long").alias("window"), minute("window_start"),
                      F.round(total, 3).alias("total"))


def q_causal_difference(spark, sf):
    """Readings whose never-measured flag differs between hindsight and live knowledge."""
    readings = materialize(wide(spark, sf))
    keys = ["stay_id", "charttime"]
    flags = [f"{p}_structurally_missing_in_stay" for p in C.PARAMS]
    hindsight = impute.locf_companions(readings, {}).select(*keys, *flags)
    live = impute.locf_companions(readings, {}, causal=True).select(
        *keys, *[F.col(f).alias(f"live_{f}") for f in flags])
    both = hindsight.join(live, keys).agg(
        *[F.count_if(F.col(f) != F.col(f"live_{f}")).alias(p) for p, f in zip(C.PARAMS, flags)])
    return both.unpivot([], list(C.PARAMS), "parameter", "readings")


def q_stay_summary(spark, sf):
    return wide(spark, sf).groupBy(F.col("stay_id").cast("long").alias("stay_id")).agg(
        F.count(F.lit(1)).alias("readings"), F.countDistinct("spo2").alias("spo2_values"),
        F.round(F.min_by("spo2", F.when(F.col("spo2").isNotNull(), F.col("charttime"))), 4)
        .alias("first_spo2"),
        F.round((micros(F.max("charttime")) - micros(F.min("charttime"))) / 3.6e9, 4).alias("span_hours"))


def q_category_levels(spark, sf):
    stays = TD.admissions(spark, sf)
    return assemble.category_levels(stays)


def q_export_times(spark, sf):
    """Times written the way the reference exports write them, read back."""
    text = F.date_format("charttime", "M/d/yyyy H:mm")
    rows = TD.events(spark, sf).select(compare.parse_export_time(text).alias("charttime"))
    return rows.groupBy(F.date_trunc("hour", "charttime").alias("hr")).agg(
        F.count(F.lit(1)).alias("rows")).select(minute("hr"), "rows")


QUERIES = {
    "sliding_windows": q_sliding_windows,
    "causal_difference": q_causal_difference,
    "stay_summary": q_stay_summary,
    "category_levels": q_category_levels,
    "export_times": q_export_times,
    "item_extract": q_item_extract,
    "cohort_strict": q_cohort_strict,
    "cohort_union": q_cohort_union,
    "evidence_report": q_evidence_report,
    "plausibility_report": q_plausibility,
    "pivot_wide": q_pivot,
    "fill_rates": q_fill_rates,
    "locf_companions": q_locf,
    "locf_causal": q_locf_causal,
    "elapsed_in_stay": q_elapsed_in_stay,
    "interval_drug_state": q_drug_state,
    "asof_mode": q_mode_state,
    "intervention_prevalence": q_intervention_prevalence,
    "mode_values": q_mode_values,
    "forward_labels": q_forward_labels,
    "label_prevalence": q_label_prevalence,
    "vac_days": q_vac,
    "hourly_forward": q_hourly_forward,
    "body_metrics": q_body_metrics,
    "patient_summary": q_patient_summary,
    "patient_split": q_patient_split,
    "sampled_stays": q_sampled_stays,
    "stay_weights": q_stay_weights,
    "column_health": q_column_health,
    "accounting": q_accounting,
    "missing_items": q_missing_items,
    "agreement": q_agreement,
    "key_overlap": q_key_overlap,
}

# ------------------------------------------------------------------ oracles
_EP = "epoch_us({0}) // 60000000 AS {1}"


def _min(c: str, name: str | None = None) -> str:
    return _EP.format(c, name or c.split(".")[-1])


_ITEMS = ", ".join(map(str, C.CACHED_ITEMS))
_SOURCE = ", ".join(map(str, C.SOURCE_ITEMS))

LONG = f"SELECT * FROM chartevents WHERE itemid IN ({_ITEMS}) AND stay_id IS NOT NULL"
USER_STAYS = """SELECT stay_id, 'U' || (stay_id % 4) AS first_careunit, min(charttime) AS intime,
  max(charttime) AS outtime FROM ev GROUP BY stay_id"""
STRICT_USERS = """SELECT s.stay_id, s.first_careunit, vent_start, vent_end, n AS n_vent_events,
  date_diff('hour', vent_start, vent_end) AS vent_hours, 'strict' AS cohort_source
  FROM user_stays s JOIN (SELECT stay_id, min(starttime) AS vent_start,
    max(coalesce(endtime, starttime)) AS vent_end, count(*) AS n
    FROM procedures_of_users WHERE itemid = 225792 GROUP BY stay_id) p USING (stay_id)
  WHERE vent_end > vent_start"""
EVIDENCE = """SELECT stay_id, min(charttime) AS s, max(charttime) AS e,
  max(CASE WHEN itemid = 223849 THEN 1 ELSE 0 END) AS m,
  max(CASE WHEN itemid = 226732 AND value IN ('Endotracheal tube', 'Tracheostomy tube')
      THEN 1 ELSE 0 END) AS a,
  max(CASE WHEN itemid = 220339 THEN 1 ELSE 0 END) AS p
  FROM long WHERE itemid IN (223849, 226732, 220339) GROUP BY stay_id"""
COHORT = """SELECT * FROM strict_users UNION ALL
  SELECT e.stay_id, u.first_careunit, e.s, e.e, 0, date_diff('hour', e.s, e.e), 'evidence'
  FROM evidence e LEFT JOIN user_stays u USING (stay_id)
  WHERE (m = 1 OR a = 1) AND e.e > e.s AND e.stay_id NOT IN (SELECT stay_id FROM strict_users)"""


def _plausible(param: str, item: int) -> str:
    v = "valuenum"
    if item == C.ITEM_FIO2:
        v = "(CASE WHEN valuenum > 0 AND valuenum <= 1.0 THEN valuenum * 100 ELSE valuenum END)"
    lo, hi = C.PLAUSIBLE[param]
    return f"CASE WHEN itemid = {item} AND {v} BETWEEN {lo} AND {hi} THEN {v} END"


def _pivot_sql(fn: str) -> str:
    columns = ", ".join(
        f"coalesce({', '.join(f'{fn}({_plausible(p, i)})' for i in items)}, NULL) AS {p}"
        for p, items in C.PARAM_ITEMS.items()
    )
    return f"""SELECT c.stay_id, min(c.subject_id) AS subject_id, c.charttime, {columns},
      max(c.warning) AS warning
      FROM long c JOIN cohort h USING (stay_id)
      WHERE c.itemid IN ({_SOURCE}) AND c.charttime BETWEEN h.vent_start AND h.vent_end
      GROUP BY c.stay_id, c.charttime"""


_ANY = " OR ".join(f"{p} IS NOT NULL" for p in C.PARAMS)
WIDE = f"SELECT * FROM ({_pivot_sql('median')}) WHERE {_ANY}"

BASE = {
    "long": LONG, "user_stays": USER_STAYS, "strict_users": STRICT_USERS, "evidence": EVIDENCE,
    "cohort": COHORT,
}
BASE_WIDE = {**BASE, "wide": WIDE}
_SRC = ["chartevents", "procedures_of_users"]
_SRC_DRUG = [*_SRC, "inputevents", "d_items"]

_STRATUM = """CASE WHEN n_pos / n_rows >= 0.30 THEN 4 WHEN n_pos / n_rows >= 0.10 THEN 3
  WHEN n_pos / n_rows >= 0.02 THEN 2 WHEN n_pos / n_rows >= 1e-12 THEN 1 ELSE 0 END"""
PEOPLE = f"""SELECT *, {_STRATUM} AS strat FROM (
  SELECT subject_id, count(*) AS n_rows, CAST(sum(warning) AS BIGINT) AS n_pos,
         count(DISTINCT stay_id) AS n_stays FROM wide GROUP BY subject_id)"""
SPLIT = """SELECT subject_id, n_rows, n_pos, n_stays, strat,
  CASE WHEN rn <= tn THEN 'test' ELSE 'train' END AS split,
  CASE WHEN rn <= tn THEN -1 ELSE (rn - tn - 1) % 5 END AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY strat ORDER BY substr(md5('42|' || subject_id), 1, 12)) AS rn,
               CAST(ceil(count(*) OVER (PARTITION BY strat) * 0.2) AS BIGINT) AS tn FROM people)"""
SPLIT_STEPS = {**BASE_WIDE, "people": PEOPLE, "split": SPLIT}


def _locf_step(causal: bool, time: str = "charttime") -> str:
    frame = "OVER (PARTITION BY stay_id ORDER BY charttime ROWS UNBOUNDED PRECEDING)"
    scope = frame if causal else "OVER (PARTITION BY stay_id)"
    inner, outer = [], []
    for p in C.PARAMS:
        inner += [
            f"last_value({p} IGNORE NULLS) {frame} AS v_{p}",
            f"last_value(CASE WHEN {p} IS NOT NULL THEN charttime END IGNORE NULLS) {frame}"
            f" AS t_{p}",
            f"count({p}) {scope} AS n_{p}",
        ]
        age = f"date_diff('microsecond', t_{p}, charttime) / 60000000.0"
        locf = f"CASE WHEN {age} <= 240 THEN v_{p} END"
        outer += [
            f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END AS {p}_observed",
            f"round({age}, 4) AS {p}_delta_t_min",
            f"round({locf}, 4) AS {p}_locf",
            f"CASE WHEN n_{p} = 0 THEN 1 ELSE 0 END AS {p}_structurally_missing_in_stay",
            f"round(coalesce({locf}, (SELECT median(w.{p}) FROM wide w JOIN split USING (subject_id)"
            f" WHERE split = 'train')), 4) AS {p}_final",
        ]
    return f"SELECT stay_id, {time}, {', '.join(outer)} FROM (SELECT *, {', '.join(inner)} FROM wide)"


def _locf_sql(causal: bool) -> str:
    return with_sources(_SRC, SPLIT_STEPS, _locf_step(causal, _min("charttime")))


DRUG_MAP = " UNION ALL ".join(
    f"SELECT '{g}' AS grp, itemid FROM d_items WHERE linksto = 'inputevents'"
    f" AND regexp_matches(lower(label), '{p}')"
    for g, p in C.DRUG_PATTERNS.items()
)
INFUSIONS = """SELECT i.stay_id, m.grp, i.starttime, i.endtime, coalesce(i.rate, 0) AS rate
  FROM inputevents i JOIN drug_map m USING (itemid)
  WHERE i.statusdescription IS DISTINCT FROM 'Rewritten'
    AND i.stay_id IN (SELECT stay_id FROM wide)"""


def _drug_columns() -> str:
    return ", ".join(
        f"max(CASE WHEN f.grp = '{g}' THEN 1 ELSE 0 END) AS {g}_running,"
        f" round(coalesce(sum(CASE WHEN f.grp = '{g}' THEN f.rate END), 0), 3) AS {g}_rate,"
        f" CAST(coalesce(max(CASE WHEN f.grp = '{g}' THEN"
        f" date_diff('minute', f.starttime, w.charttime) END), -1) AS DOUBLE)"
        f" AS {g}_minutes_since_start"
        for g in C.DRUG_GROUPS
    )


DRUGS = f"""SELECT w.stay_id, w.charttime, {_drug_columns()}
  FROM wide w LEFT JOIN infusions f ON f.stay_id = w.stay_id AND f.starttime < w.charttime
    AND coalesce(f.endtime, f.starttime) > w.charttime
  GROUP BY w.stay_id, w.charttime"""
MODES = ("SELECT stay_id, charttime AS mt, max(value) AS ventilator_mode FROM long"
         " WHERE itemid = 223849 AND value IS NOT NULL GROUP BY ALL")
DRUG_STEPS = {**BASE_WIDE, "drug_map": DRUG_MAP, "infusions": INFUSIONS, "drugs": DRUGS}


def _label_steps() -> dict[str, str]:
    frame = "OVER (PARTITION BY stay_id ORDER BY charttime ROWS UNBOUNDED PRECEDING)"
    carry = ", ".join(
        f"CASE WHEN date_diff('microsecond', t_{p}, charttime) / 60000000.0 <= 240 THEN v_{p} END"
        f" AS {p}_locf, date_diff('microsecond', t_{p}, charttime) / 60000000.0 AS {p}_age"
        for p in ("fio2", "peep")
    )
    inner = ", ".join(
        f"last_value({p} IGNORE NULLS) {frame} AS v_{p}, last_value(CASE WHEN {p} IS NOT NULL"
        f" THEN charttime END IGNORE NULLS) {frame} AS t_{p}"
        for p in ("fio2", "peep")
    )
    windows = ", ".join(
        f"min(spo2) OVER w{h} AS spo2_{h}, max(lasting) OVER w{h} AS fio2_{h},"
        f" max(peep) OVER w{h} AS peep_{h}, max(vaso_new) OVER w{h} AS vaso_{h}"
        for h in RULES.horizons_h
    )
    named = ", ".join(
        f"w{h} AS (PARTITION BY stay_id ORDER BY charttime RANGE BETWEEN INTERVAL 1 SECOND"
        f" FOLLOWING AND INTERVAL {h} HOUR FOLLOWING)"
        for h in RULES.horizons_h
    )
    flags = ", ".join(
        f"coalesce(fio2_{h} - fio2_locf >= 20, false) AS d_fio2_{h}h,"
        f" coalesce(peep_{h} - peep_locf >= 3, false) AS d_peep_{h}h,"
        f" coalesce(spo2_{h} < 88, false) AS d_spo2_{h}h,"
        f" coalesce(vaso_{h} = 1 AND vaso_now = 0, false) AS d_vaso_{h}h,"
        f" coalesce(fio2_{h} - fio2_locf >= 20 AND fio2_age <= 60, false) AS s_fio2_{h}h,"
        f" coalesce(peep_{h} - peep_locf >= 3 AND peep_age <= 60, false) AS s_peep_{h}h,"
        f" charttime + INTERVAL {h} HOUR <= t_end AS complete_{h}h"
        for h in RULES.horizons_h
    )
    parts = {
        "resp": "d_fio2_{h}h OR d_peep_{h}h OR d_spo2_{h}h",
        "circ": "d_vaso_{h}h",
        "composite": "d_fio2_{h}h OR d_peep_{h}h OR d_spo2_{h}h OR d_vaso_{h}h",
        "strict": "s_fio2_{h}h OR s_peep_{h}h OR d_spo2_{h}h OR d_vaso_{h}h",
    }
    ys = ", ".join(
        f"CASE WHEN {text.format(h=h)} THEN 1 WHEN complete_{h}h THEN 0 END AS y_{name}_{h}h"
        for h in RULES.horizons_h for name, text in parts.items()
    )
    return {
        **DRUG_STEPS,
        "carried": f"SELECT *, {carry} FROM (SELECT *, {inner} FROM wide)",
        "based": "SELECT c.*, coalesce(d.vasopressor_running, 0) AS vaso_now FROM carried c"
                 " LEFT JOIN drugs d USING (stay_id, charttime)",
        "marked": "SELECT *, lead(fio2 IGNORE NULLS) OVER st AS nxt, max(CASE WHEN vaso_now = 1"
                  " THEN charttime END) OVER (PARTITION BY stay_id ORDER BY charttime ROWS BETWEEN"
                  " UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_on,"
                  " max(charttime) OVER (PARTITION BY stay_id) AS t_end FROM based"
                  " WINDOW st AS (PARTITION BY stay_id ORDER BY charttime)",
        "qualified": "SELECT *, CASE WHEN fio2 IS NOT NULL AND nxt IS NOT NULL THEN"
                     " least(fio2, nxt) END AS lasting, CASE WHEN vaso_now = 1 AND (last_on IS"
                     " NULL OR date_diff('minute', last_on, charttime) >= 360) THEN 1 ELSE 0 END"
                     " AS vaso_new FROM marked",
        "fwd": f"SELECT *, {windows} FROM qualified WINDOW {named}",
        "flagged": f"SELECT stay_id, charttime, {flags} FROM fwd",
        "labels": f"SELECT *, {ys} FROM flagged",
    }


def _label_sql() -> str:
    names = []
    for h in RULES.horizons_h:
        names += [f"y_{v}_{h}h" for v in labels.VARIANTS] + [f"complete_{h}h"]
        names += [f"{c}_{h}h" for c in labels.COMPONENTS]
    cast = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)
    return with_sources(_SRC_DRUG, _label_steps(),
                        f"SELECT stay_id, {_min('charttime')}, {cast} FROM labels")


def _prevalence_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT 'y_{v}_{h}h' AS label, count(*) AS rows, count(y_{v}_{h}h) AS rows_labelled,"
        f" count(*) FILTER (WHERE y_{v}_{h}h = 1) AS positive,"
        f" count(DISTINCT CASE WHEN y_{v}_{h}h = 1 THEN stay_id END) AS stays_with_positive,"
        f" round(avg(y_{v}_{h}h), 6) AS positive_rate FROM labels"
        for v in labels.VARIANTS for h in RULES.horizons_h
    )
    return with_sources(_SRC_DRUG, _label_steps(), rows)


def _fill_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, count({p}) AS filled, count(*) AS rows,"
        f" round(100.0 * count({p}) / count(*), 4) AS pct_filled FROM wide"
        for p in C.PARAMS
    )


_LOCF, _LIVE = _locf_sql(False), _locf_sql(True)

ORACLES = {
    "sliding_windows": with_sources(
        _SRC, {**BASE_WIDE,
               "numbered": f"SELECT stay_id, charttime, coalesce({', '.join(C.PARAMS)}) AS v,"
                           " row_number() OVER (PARTITION BY stay_id ORDER BY charttime) - 1 AS i FROM wide",
               "starts": "SELECT stay_id, i, i // 4 AS win FROM numbered WHERE i % 4 = 0"},
        f"SELECT s.stay_id, s.win AS \"window\", {_min('min(n.charttime)', 'window_start')},"
        " round(sum(n.v), 3) AS total FROM starts s JOIN numbered n ON n.stay_id = s.stay_id AND"
        " n.i BETWEEN s.i AND s.i + 9 GROUP BY s.stay_id, s.win HAVING count(*) = 10"),
    "causal_difference": " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, count(*) FILTER (WHERE a.{p}_structurally_missing_in_stay <>"
        f" b.{p}_structurally_missing_in_stay) AS readings FROM a_all a JOIN b_all b"
        " USING (stay_id, charttime)" for p in C.PARAMS),
    "stay_summary": with_sources(
        _SRC, BASE_WIDE,
        "SELECT stay_id, count(*) AS readings, count(DISTINCT spo2) AS spo2_values,"
        " round(arg_min(spo2, charttime) FILTER (WHERE spo2 IS NOT NULL), 4) AS first_spo2,"
        " round(date_diff('microsecond', min(charttime), max(charttime)) / 3.6e9, 4) AS span_hours"
        " FROM wide GROUP BY stay_id"),
    "category_levels": with_sources(["admissions"], {}, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS level, count(*) AS rows FROM admissions WHERE {c} IS NOT"
        " NULL GROUP BY ALL" for c in ("admission_type", "admission_location", "insurance", "language",
                                       "marital_status", "race"))),
    "export_times": with_sources(
        ["ev"], {}, "SELECT epoch_us(date_trunc('hour', charttime)) // 60000000 AS hr, count(*) AS rows"
        " FROM ev GROUP BY 1"),
    "item_extract": with_sources(
        ["chartevents"], {"long": LONG},
        "SELECT itemid, count(*) AS rows, count(DISTINCT stay_id) AS stays,"
        " count(valuenum) AS with_value FROM long GROUP BY itemid"),
    "cohort_strict": with_sources(
        ["icustays", "procedures_of_orders"], {},
        f"""SELECT stay_id, subject_id, hadm_id, {_min('vent_start')}, {_min('vent_end')},
            n AS n_vent_events, date_diff('hour', vent_start, vent_end) AS vent_hours,
            round(los, 4) AS los
            FROM icustays JOIN (SELECT stay_id, min(starttime) AS vent_start,
              max(coalesce(endtime, starttime)) AS vent_end, count(*) AS n
              FROM procedures_of_orders WHERE itemid = 225792 GROUP BY stay_id) USING (stay_id)
            WHERE vent_end > vent_start"""),
    "cohort_union": with_sources(
        _SRC, BASE,
        f"SELECT stay_id, first_careunit, {_min('vent_start')}, {_min('vent_end')},"
        " n_vent_events, vent_hours, cohort_source FROM cohort"),
    "evidence_report": with_sources(
        _SRC, BASE,
        " UNION ALL ".join(
            f"SELECT '{n}' AS evidence, count(*) AS stays, count(*) FILTER (WHERE stay_id NOT IN"
            f" (SELECT stay_id FROM strict_users)) AS not_in_strict FROM evidence WHERE {c}"
            for n, c in (("mode", "m = 1"), ("airway", "a = 1"), ("peep", "p = 1"),
                         ("admitting", "m = 1 OR a = 1")))),
    "plausibility_report": with_sources(
        ["chartevents"], {"long": LONG},
        " UNION ALL ".join(
            f"SELECT '{p}' AS parameter, {i} AS itemid, count(*) AS n,"
            f" count(*) FILTER (WHERE ({_plausible(p, i)}) IS NULL) AS out_of_range,"
            " count(*) FILTER (WHERE valuenum > 0 AND valuenum <= 1.0) AS fraction_scale,"
            " count(*) FILTER (WHERE valuenum <= 0) AS non_positive"
            f" FROM long WHERE itemid = {i} AND valuenum IS NOT NULL HAVING count(*) > 0"
            for p, items in C.PARAM_ITEMS.items() for i in items)),
    "pivot_wide": with_sources(
        _SRC, BASE_WIDE,
        f"SELECT stay_id, {_min('charttime')}, "
        + ", ".join(f"round({p}, 4) AS {p}" for p in C.PARAMS) + ", warning FROM wide"),
    "fill_rates": with_sources(_SRC, BASE_WIDE, _fill_sql()),
    "locf_companions": _locf_sql(False),
    "locf_causal": _locf_sql(True),
    "elapsed_in_stay": with_sources(
        _SRC, BASE_WIDE,
        f"SELECT stay_id, {_min('charttime')}, round(date_diff('microsecond', min(charttime) OVER"
        " (PARTITION BY stay_id), charttime) / 60000000.0, 4) AS minutes_in_stay FROM wide"),
    "interval_drug_state": with_sources(
        _SRC_DRUG, DRUG_STEPS,
        f"SELECT stay_id, {_min('charttime')}, * EXCLUDE (stay_id, charttime) FROM drugs"),
    "asof_mode": with_sources(
        _SRC, {**BASE_WIDE, "modes": MODES},
        f"SELECT w.stay_id, {_min('w.charttime')}, m.ventilator_mode,"
        " CAST(coalesce(date_diff('minute', m.mt, w.charttime), -1) AS DOUBLE)"
        " AS ventilator_mode_age_min"
        " FROM wide w ASOF LEFT JOIN modes m ON w.stay_id = m.stay_id AND w.charttime > m.mt"),
    "intervention_prevalence": with_sources(
        _SRC_DRUG, DRUG_STEPS,
        " UNION ALL ".join(f"SELECT '{g}' AS grp, round(100.0 * avg({g}_running), 4) AS pct_running"
                           " FROM drugs" for g in C.DRUG_GROUPS)),
    "mode_values": with_sources(
        _SRC, {**BASE_WIDE, "modes":
               "SELECT stay_id, charttime AS mt, max(value) AS m FROM long"
               " WHERE itemid = 223849 AND value IS NOT NULL GROUP BY ALL"},
        "SELECT coalesce(m.m, '') AS mode, count(*) AS readings FROM wide w ASOF LEFT JOIN modes m"
        " ON w.stay_id = m.stay_id AND w.charttime > m.mt GROUP BY ALL"),
    "forward_labels": _label_sql(),
    "label_prevalence": _prevalence_sql(),
    "vac_days": with_sources(
        _SRC, {**BASE_WIDE,
               "daily": "SELECT stay_id, CAST(charttime AS DATE) AS day, min(peep) AS p,"
                        " min(fio2) AS f FROM wide WHERE peep IS NOT NULL OR fio2 IS NOT NULL"
                        " GROUP BY ALL",
               "seq": "SELECT *, count(*) OVER (PARTITION BY stay_id) AS n_days,"
                      " least(lag(p, 1) OVER w, lag(p, 2) OVER w) AS bp,"
                      " least(lag(f, 1) OVER w, lag(f, 2) OVER w) AS bf,"
                      " lead(p) OVER w AS np, lead(f) OVER w AS nf FROM daily"
                      " WINDOW w AS (PARTITION BY stay_id ORDER BY day)"},
        "SELECT stay_id, max(n_days) AS n_days, max(CASE WHEN n_days >= 4 AND ((p - bp >= 3 AND"
        " np - bp >= 3) OR (f - bf >= 20 AND nf - bf >= 20)) THEN 1 ELSE 0 END) AS vac"
        " FROM seq GROUP BY stay_id"),
    "hourly_forward": with_sources(
        _SRC_DRUG, {**DRUG_STEPS,
                    "hourly": "SELECT w.stay_id, date_trunc('hour', w.charttime) AS hr,"
                              " min(fio2) AS f0, max(fio2) AS f1, min(peep) AS p0,"
                              " max(peep) AS p1, min(spo2) AS s0,"
                              " max(coalesce(vasopressor_running, 0)) AS v"
                              " FROM wide w LEFT JOIN drugs USING (stay_id, charttime)"
                              " GROUP BY ALL",
                    "fwd": "SELECT a.stay_id, a.hr, a.f0, a.p0, a.v, max(b.f1) AS fa,"
                           " max(b.p1) AS pa, min(b.s0) AS sa, max(b.v) AS va FROM hourly a"
                           " LEFT JOIN hourly b ON a.stay_id = b.stay_id AND b.hr > a.hr AND"
                           " b.hr <= a.hr + INTERVAL 6 HOUR GROUP BY ALL",
                    "flags": "SELECT stay_id, hr, coalesce(fa - f0 >= 20, false) OR"
                             " coalesce(pa - p0 >= 3, false) AS escalation,"
                             " coalesce(sa < 88, false) AS desaturation,"
                             " coalesce(va = 1 AND v = 0, false) AS pressor FROM fwd"},
        f"SELECT stay_id, {_min('hr')}, CAST(escalation AS BIGINT) AS escalation,"
        " CAST(desaturation AS BIGINT) AS desaturation,"
        " CAST(escalation OR desaturation OR pressor AS BIGINT) AS composite FROM flags"),
    "body_metrics": with_sources(
        ["chartevents"], {
            "scaled": "SELECT stay_id, charttime, CASE WHEN itemid IN (226730, 226707) THEN"
                      " 'h' ELSE 'w' END AS metric, valuenum * CASE itemid WHEN 226531 THEN"
                      " 0.45359237 WHEN 226707 THEN 2.54 ELSE 1.0 END AS x FROM chartevents"
                      " WHERE itemid IN (226512, 224639, 226531, 226730, 226707)"
                      " AND valuenum IS NOT NULL",
            "ranked": "SELECT *, row_number() OVER (PARTITION BY stay_id, metric ORDER BY"
                      " charttime, x) AS rn FROM scaled WHERE (metric = 'h' AND x BETWEEN 100 AND"
                      " 250) OR (metric = 'w' AND x BETWEEN 20 AND 400)"},
        "SELECT stay_id, round(max(CASE WHEN metric = 'h' THEN x END), 4) AS height_cm,"
        " round(max(CASE WHEN metric = 'w' THEN x END), 4) AS weight_kg FROM ranked WHERE rn = 1"
        " GROUP BY stay_id"),
    "patient_summary": with_sources(
        _SRC, {**BASE_WIDE, "people": PEOPLE},
        "SELECT subject_id, n_rows, n_pos, n_stays, strat FROM people"),
    "patient_split": with_sources(
        _SRC, SPLIT_STEPS, "SELECT subject_id, n_rows, n_pos, n_stays, strat, split, fold FROM split"),
    "sampled_stays": with_sources(
        _SRC, BASE_WIDE,
        f"SELECT stay_id, {_min('charttime')} FROM wide WHERE stay_id IN (SELECT stay_id FROM"
        " (SELECT DISTINCT stay_id FROM wide) ORDER BY md5('42|' || stay_id), stay_id LIMIT 25)"),
    "stay_weights": with_sources(
        _SRC, BASE_WIDE,
        f"SELECT stay_id, {_min('charttime')}, round((1.0 / n) / avg(1.0 / n) OVER (), 6) AS weight"
        " FROM (SELECT *, count(*) OVER (PARTITION BY stay_id) AS n FROM wide)"),
    "column_health": with_sources(
        _SRC, BASE_WIDE,
        " UNION ALL ".join(
            f"SELECT '{p}' AS \"column\", count({p}) AS filled, count({p}) = 0 AS dead,"
            f" count(DISTINCT {p}) = 1 AS constant FROM wide" for p in C.PARAMS)),
    "accounting": with_sources(
        _SRC, BASE_WIDE,
        " UNION ALL ".join(
            f"SELECT '{n}' AS stage, count(*) AS rows, count(DISTINCT stay_id) AS stays,"
            f" count(DISTINCT stay_id // 2) AS patients FROM {t}"
            for n, t in (("events", "long"), ("cohort", "cohort"), ("wide", "wide")))),
    "missing_items": with_sources(
        ["chartevents"], {}, f"SELECT CAST(unnest([{_ITEMS}]) AS INTEGER) AS itemid EXCEPT"
        " SELECT itemid FROM chartevents"),
    "agreement": with_sources(
        _SRC, {**BASE_WIDE, "mean": _pivot_sql("avg")},
        " UNION ALL ".join(
            f"SELECT '{p}' AS \"column\", count(*) AS matched, count(w.{p} + m.{p}) AS \"both\","
            f" round(100.0 * count(*) FILTER (WHERE abs(w.{p} - m.{p}) <= 0.01 * abs(m.{p}) + 0.01)"
            f" / nullif(count(w.{p} + m.{p}), 0), 4) AS pct_within"
            " FROM wide w JOIN mean m USING (stay_id, charttime)" for p in C.PARAMS)),
    "key_overlap": with_sources(
        [*_SRC, "inputevents"], BASE_WIDE,
        "SELECT (SELECT count(DISTINCT stay_id) FROM wide) AS left_keys,"
        " (SELECT count(DISTINCT stay_id) FROM inputevents) AS right_keys,"
        " (SELECT count(*) FROM (SELECT stay_id FROM wide INTERSECT SELECT stay_id FROM"
        " inputevents)) AS shared_keys"),
}
ORACLES["causal_difference"] = (
    f"WITH a_all AS ({_LOCF}), b_all AS ({_LIVE}) " + ORACLES["causal_difference"])
