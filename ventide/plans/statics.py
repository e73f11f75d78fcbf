"""Registered queries over the per-stay tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ventide.functions import timefn
from ventide.operators import cohort, comorbidity, static
from ventide.plans.sources_sql import with_sources
from ventide.plans.timeseries import r
from ventide.sources import testdata as TD


def strict(spark, sf):
    return cohort.strict_cohort(TD.icustays(spark, sf), TD.procedures_of_orders(spark, sf))


def q_charlson_flags(spark, sf):
    out = comorbidity.category_flags(TD.diagnoses(spark, sf))
    return out.withColumn("score", comorbidity.score()).withColumn(
        "score_flat", comorbidity.score(hierarchy=False))


def q_icd_versions(spark, sf):
    return comorbidity.version_counts(TD.diagnoses(spark, sf))


def q_static_table(spark, sf):
    from ventide.plans.timeseries import ts_long

    table = static.static_table(
        strict(spark, sf), TD.patients(spark, sf), TD.admissions(spark, sf),
        TD.diagnoses(spark, sf), static.body_metrics(ts_long(spark, sf)))
    keep = ["stay_id", "gender", "age_at_icu", "admission_type", "admission_location", "insurance",
            "race", "first_careunit", "hours_admit_to_icu", "ed_minutes", "prior_icu_stays",
            "charlson_comorbidity_score", "charlson_age_points", "charlson_index"]
    return table.select(*keep, r("height_cm"), r("weight_kg"), r("pbw_kg"), r("leaky_icu_los_days"))


def q_outcomes(spark, sf):
    stays = strict(spark, sf)
    return static.outcomes(stays, TD.admissions(spark, sf), TD.patients(spark, sf),
                           TD.icustays(spark, sf), TD.procedures_of_orders(spark, sf)).select(
        "stay_id", *[F.col(c).cast("long").alias(c) for c in (
            "in_hospital_mortality", "icu_mortality", "mortality_28d", "mortality_90d",
            "prolonged_ventilation", "extubation_failure", "icu_readmission", "vent_hours")],
        r("icu_los_days"))


def q_outcome_rates(spark, sf):
    table = q_outcomes(spark, sf)
    names = [c for c in table.columns if c not in ("stay_id", "vent_hours", "icu_los_days")]
    rates = table.agg(*[(100.0 * F.avg(c)).alias(c) for c in names])
    return rates.unpivot([], names, "outcome", "pct").select("outcome", r("pct"))


def q_date_differences(spark, sf):
    """Unit boundaries crossed and complete units between ICU start and end."""
    a, b = F.col("intime"), F.col("outtime")
    shifted = F.timestamp_micros(timefn.micros(b) + F.col("stay_id") % 97 * 61_000_000)
    return TD.icustays(spark, sf).select(
        "stay_id",
        *[timefn.boundary_diff(u, a, shifted).cast("long").alias(f"{u}s")
          for u in ("minute", "hour", "day")],
        timefn.elapsed_whole_hours(a, shifted).cast("long").alias("whole_hours"))


def q_visit_statistics(spark, sf):
    """Exact medians and quartiles of ventilation hours per care unit."""
    return strict(spark, sf).groupBy("first_careunit").agg(
        F.count(F.lit(1)).alias("stays"), F.countDistinct("subject_id").alias("patients"),
        F.round(F.percentile("vent_hours", 0.25), 4).alias("p25"),
        F.round(F.median("vent_hours"), 4).alias("median"),
        F.round(F.percentile("vent_hours", 0.75), 4).alias("p75"))


QUERIES = {
    "charlson_flags": q_charlson_flags,
    "icd_versions": q_icd_versions,
    "static_table": q_static_table,
    "outcomes": q_outcomes,
    "outcome_rates": q_outcome_rates,
    "date_differences": q_date_differences,
    "visit_statistics": q_visit_statistics,
}

STRICT = """SELECT i.*, vent_start, vent_end, date_diff('hour', vent_start, vent_end) AS vent_hours
  FROM icustays i JOIN (SELECT stay_id, min(starttime) AS vent_start,
    max(coalesce(endtime, starttime)) AS vent_end FROM procedures_of_orders
    WHERE itemid = 225792 GROUP BY stay_id) USING (stay_id) WHERE vent_end > vent_start"""


def _category(ninth: str, tenth: str) -> str:
    test = lambda text: " OR ".join(
        f"starts_with(code, '{p}')" for p in comorbidity.expand(text))
    return f"(icd_version = 9 AND ({test(ninth)})) OR (icd_version = 10 AND ({test(tenth)}))"


FLAGS = "SELECT hadm_id, " + ", ".join(
    f"max(CASE WHEN {_category(n9, n10)} THEN 1 ELSE 0 END) AS cci_{name}"
    for name, _, n9, n10 in comorbidity.CATEGORIES
) + (" FROM (SELECT hadm_id, icd_version, upper(trim(icd_code)) AS code FROM diagnoses)"
     " GROUP BY hadm_id")


def _score(hierarchy: bool) -> str:
    terms = []
    for name, weight, *_ in comorbidity.CATEGORIES:
        flag = f"coalesce(cci_{name}, 0)"
        if hierarchy and name in comorbidity.GRADED:
            flag = (f"CASE WHEN coalesce(cci_{comorbidity.GRADED[name]}, 0) = 1 THEN 0"
                    f" ELSE {flag} END")
        terms.append(f"{weight} * ({flag})")
    return " + ".join(terms)


_AGE = ("CASE WHEN age_at_icu IS NULL OR age_at_icu <= 50 THEN 0 WHEN age_at_icu <= 60 THEN 1 WHEN"
        " age_at_icu <= 70 THEN 2 WHEN age_at_icu <= 80 THEN 3 ELSE 4 END")
BODY = """SELECT stay_id, max(CASE WHEN m = 'h' THEN x END) AS height_cm,
  max(CASE WHEN m = 'w' THEN x END) AS weight_kg FROM (
    SELECT *, row_number() OVER (PARTITION BY stay_id, m ORDER BY charttime, x) AS rn FROM (
      SELECT stay_id, charttime, CASE WHEN itemid = 226730 THEN 'h' ELSE 'w' END AS m,
        valuenum * CASE itemid WHEN 226531 THEN 0.45359237 ELSE 1.0 END AS x
      FROM chartevents WHERE itemid IN (226531, 226730) AND valuenum IS NOT NULL)
    WHERE (m = 'h' AND x BETWEEN 100 AND 250) OR (m = 'w' AND x BETWEEN 20 AND 400))
  WHERE rn = 1 GROUP BY stay_id"""
STATIC = f"""SELECT *, {_score(True)} AS s, {_AGE} AS a FROM (
  SELECT c.stay_id, p.gender, p.anchor_age + year(c.intime) - p.anchor_year AS age_at_icu,
    a.admission_type, a.admission_location, a.insurance, a.language, a.marital_status, a.race,
    c.first_careunit,
    date_diff('hour', a.admittime, c.intime) AS hours_admit_to_icu,
    date_diff('minute', a.edregtime, a.edouttime) AS ed_minutes,
    row_number() OVER (PARTITION BY c.subject_id ORDER BY c.intime, c.stay_id) - 1
      AS prior_icu_stays,
    b.height_cm, b.weight_kg, c.los, f.* EXCLUDE (hadm_id)
  FROM strict c LEFT JOIN patients p USING (subject_id) LEFT JOIN admissions a USING (hadm_id)
  LEFT JOIN flags f ON f.hadm_id = c.hadm_id LEFT JOIN body b ON b.stay_id = c.stay_id)"""
OUTCOMES = """SELECT c.stay_id, coalesce(a.hospital_expire_flag, 0) AS in_hospital_mortality,
  CASE WHEN a.deathtime BETWEEN c.intime AND coalesce(c.outtime, a.dischtime) THEN 1 ELSE 0 END
    AS icu_mortality,
  CASE WHEN date_diff('day', c.intime, p.dod) <= 28 THEN 1 ELSE 0 END AS mortality_28d,
  CASE WHEN date_diff('day', c.intime, p.dod) <= 90 THEN 1 ELSE 0 END AS mortality_90d,
  CASE WHEN c.vent_hours > 168 THEN 1 ELSE 0 END AS prolonged_ventilation,
  coalesce(r.f, 0) AS extubation_failure, coalesce(rd.f, 0) AS icu_readmission, c.vent_hours,
  round(c.los, 4) AS icu_los_days
  FROM strict c LEFT JOIN admissions a USING (hadm_id) LEFT JOIN patients p USING (subject_id)
  LEFT JOIN (SELECT stay_id, max(CASE WHEN date_diff('hour', endtime, nx) BETWEEN 0 AND 48 THEN 1
      ELSE 0 END) AS f FROM (SELECT *, lead(starttime) OVER (PARTITION BY stay_id ORDER BY
      starttime, endtime NULLS FIRST) AS nx FROM procedures_of_orders WHERE itemid = 225792)
    GROUP BY stay_id) r ON r.stay_id = c.stay_id
  LEFT JOIN (SELECT x.stay_id, CASE WHEN count(y.stay_id) > 0 THEN 1 ELSE 0 END AS f
    FROM icustays x LEFT JOIN icustays y ON x.hadm_id = y.hadm_id AND y.intime > x.outtime
    GROUP BY x.stay_id) rd ON rd.stay_id = c.stay_id"""
_OUT_SRC = ["icustays", "procedures_of_orders", "admissions", "patients"]
_OUT_NAMES = ("in_hospital_mortality", "icu_mortality", "mortality_28d", "mortality_90d",
              "prolonged_ventilation", "extubation_failure", "icu_readmission")

ORACLES = {
    "charlson_flags": with_sources(["diagnoses"], {"flags": FLAGS},
        f"SELECT *, {_score(True)} AS score, {_score(False)} AS score_flat FROM flags"),
    "icd_versions": with_sources(["diagnoses"], {}, "SELECT count(*) AS codes, CAST(sum(CASE WHEN icd_version = 9 THEN 1"
                                 " ELSE 0 END) AS BIGINT) AS icd9, CAST(sum(CASE WHEN icd_version = 10 THEN 1 ELSE 0 END)"
                                 " AS BIGINT) AS icd10 FROM diagnoses"),
    "static_table": with_sources(
        ["icustays", "procedures_of_orders", "patients", "admissions", "diagnoses", "chartevents"],
        {"strict": STRICT, "flags": FLAGS, "body": BODY, "st": STATIC},
        "SELECT stay_id, gender, age_at_icu, admission_type, admission_location, insurance, race,"
        " first_careunit, hours_admit_to_icu, ed_minutes, prior_icu_stays,"
        " s AS charlson_comorbidity_score, a AS charlson_age_points, s + a AS charlson_index,"
        " round(height_cm, 4) AS height_cm, round(weight_kg, 4) AS weight_kg,"
        " round(CASE WHEN height_cm IS NULL OR gender IS NULL THEN NULL WHEN gender = 'M'"
        " THEN 50.0 + 2.3 * (height_cm / 2.54 - 60) ELSE 45.5 + 2.3 * (height_cm / 2.54 - 60) END, 4)"
        " AS pbw_kg, round(los, 4) AS leaky_icu_los_days FROM st"),
    "outcomes": with_sources(_OUT_SRC, {"strict": STRICT}, OUTCOMES),
    "outcome_rates": with_sources(
        _OUT_SRC, {"strict": STRICT, "t4": OUTCOMES},
        " UNION ALL ".join(f"SELECT '{n}' AS outcome, round(100.0 * avg({n}), 4) AS pct FROM t4"
                           for n in _OUT_NAMES)),
    "date_differences": with_sources(
        ["icustays"], {"s": "SELECT *, outtime + to_seconds(stay_id % 97 * 61) AS o FROM icustays"},
        "SELECT stay_id, date_diff('minute', intime, o) AS minutes, date_diff('hour', intime, o) AS"
        " hours, date_diff('day', intime, o) AS days, date_sub('hour', intime, o) AS whole_hours"
        " FROM s"),
    "visit_statistics": with_sources(
        ["icustays", "procedures_of_orders"], {"strict": STRICT},
        "SELECT first_careunit, count(*) AS stays, count(DISTINCT subject_id) AS patients,"
        " round(quantile_cont(vent_hours, 0.25), 4) AS p25, round(median(vent_hours), 4) AS median,"
        " round(quantile_cont(vent_hours, 0.75), 4) AS p75 FROM strict GROUP BY first_careunit"),
}
