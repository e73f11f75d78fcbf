"""Registered queries over the whole feature matrix: as trained, and as a live system builds it.

The matrix has 109 columns per reading: five companions of eleven parameters, drug state and mode,
the static row, and tidal volume per predicted weight. Its target is a worsening of breathing
within six hours.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators import assemble, impute, interventions, labels, serving, split
from ventide.operators import comorbidity as CM
from ventide.plans import statics as ST
from ventide.plans import streams
from ventide.plans import timeseries as TS
from ventide.plans.sources_sql import with_sources
from ventide.plans.timeseries import minute, r
from ventide.session import materialize, shared_folder
from ventide.sources import testdata as TD
from ventide.streaming import processors as P

TARGET = C.Settings().target


class Matrix:
    """The parts of the training matrix under `settings`; each is written once, when it is first asked for."""

    #: Parts that depend on no setting of the label rules and on no flag but `causal` (the last one).
    COMMON = ("log", "cohort", "readings", "folds", "medians", "modes", "carried")

    def __init__(self, spark, sf: str, settings: C.Settings = C.Settings()):
        self.spark, self.sf, self.settings = spark, sf, settings

    def variant(self, settings: C.Settings) -> Matrix:
        """The matrix under other settings; what cannot differ is not computed again."""
        other = Matrix(self.spark, self.sf, settings)
        same = settings.flags.causal == self.settings.flags.causal
        for name in self.COMMON if same else self.COMMON[:-1]:
            other.__dict__[name] = getattr(self, name)
        if settings.flags == self.settings.flags:
            for name in ("infusions", "static", "drugs", "matrix"):
                other.__dict__[name] = getattr(self, name)
        return other

    @cached_property
    def log(self) -> DataFrame:
        return materialize(TS.ts_long(self.spark, self.sf))

    @cached_property
    def cohort(self) -> DataFrame:
        return materialize(TS.final_cohort(self.spark, self.sf, self.log))

    @cached_property
    def readings(self) -> DataFrame:
        return materialize(TS.pivot.events_to_wide(self.log, self.cohort))

    @cached_property
    def folds(self) -> DataFrame:
        return materialize(split.patient_split(self.readings))

    @cached_property
    def medians(self) -> dict[str, float | None]:
        return impute.reference_medians(self.readings, self.folds)

    @cached_property
    def infusions(self) -> DataFrame:
        return materialize(TS.infusion_rows(self.spark, self.sf, self.readings, self.settings.flags))

    @cached_property
    def modes(self) -> DataFrame:
        return materialize(interventions.modes(self.log))

    @cached_property
    def static(self) -> DataFrame:
        stays = self.cohort
        if not self.settings.flags.final_cohort:  # the static table once was made before the cohort was widened
            stays = stays.join(TS.cohort.strict_cohort(
                TS.user_stays(self.spark, self.sf), TD.procedures_of_users(self.spark, self.sf)).select("stay_id"), "stay_id", "left_semi")
        return materialize(TS.static_of(self.spark, self.sf, stays, self.settings.flags))

    @cached_property
    def carried(self) -> DataFrame:
        return materialize(impute.locf_companions(self.readings, self.medians, self.settings.flags.causal))

    @cached_property
    def drugs(self) -> DataFrame:
        return materialize(interventions.interventions(self.readings, self.infusions, self.modes))

    @cached_property
    def planned(self) -> DataFrame:
        """The matrix before it is written, for those who read it once."""
        return assemble.assemble(self.carried, self.drugs, self.static, self.folds, self.settings.flags)

    @cached_property
    def matrix(self) -> DataFrame:
        return materialize(self.planned)

    @cached_property
    def manifest(self) -> dict:
        return assemble.manifest(self.planned, self.drugs, self.static, self.settings)

    @cached_property
    def labels(self) -> DataFrame:
        pressors = self.drugs.select("stay_id", "charttime", "vasopressor_running")
        base = materialize(self.carried.join(pressors, ["stay_id", "charttime"], "left"))
        return materialize(labels.forward_labels(base.drop("vasopressor_running"), base, self.settings.labels))

    @cached_property
    def aligned(self) -> DataFrame:
        """The rows a model learns from: features, y, split and fold."""
        return materialize(assemble.align_labels(self.matrix, self.labels, self.settings.target))


def shown(df: DataFrame, features: tuple[str, ...]) -> list[F.Column]:
    """The features in comparable types: numbers rounded, small integers widened."""
    kinds = dict(df.dtypes)
    out = []
    for c in features:
        if kinds[c] == "string":
            out.append(F.col(c))
        elif kinds[c] in ("double", "float"):
            out.append(r(c, 3 if c.endswith("_rate") else 4))
        else:
            out.append(F.col(c).cast("long").alias(c))
    return out


def q_feature_matrix(spark, sf):
    """Every reading with a known target: 109 features, the target, split and fold."""
    m = Matrix(spark, sf)
    return m.aligned.select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(), F.col("y").cast("long").alias("y"), "split",
        F.col("fold").cast("long").alias("fold"), *shown(m.matrix, tuple(m.manifest["sets"]["full"])))


def q_feature_manifest(spark, sf):
    """Kind and group of every feature, and whether its values are one of frozen levels."""
    m = Matrix(spark, sf)
    rows = [(f, *assemble.feature_kind(f, m.manifest), f in m.manifest["categorical"])
            for f in m.manifest["sets"]["full"]]
    filled = assemble.filled_counts(m.planned, m.manifest["sets"]["full"]).withColumnRenamed("column", "feature")
    kinds = spark.createDataFrame(rows, "feature string, kind string, source string, categorical boolean")
    return kinds.join(filled, "feature")


def q_matrix_guards(spark, sf):
    m = Matrix(spark, sf)
    return assemble.guards(m.planned, m.readings, m.labels)


def charted(m: Matrix) -> DataFrame:
    """Readings, modes and infusions as one stream of chart entries."""
    began = m.cohort.select("stay_id", "vent_start")
    stays = m.readings.select("stay_id").distinct()
    readings = m.readings.join(began, "stay_id").select("stay_id", "charttime", "vent_start", F.lit(True).alias("is_reading"), *C.PARAMS)
    modes = m.modes.join(stays, "stay_id", "left_semi").select(
        "stay_id", F.col("mode_time").alias("charttime"), F.lit(False).alias("is_reading"), "ventilator_mode")
    drugs = m.infusions.select("stay_id", F.col("starttime").alias("charttime"), F.lit(False).alias("is_reading"),
                               "grp", "endtime", "rate")
    rows = readings.unionByName(modes, allowMissingColumns=True).unionByName(drugs, allowMissingColumns=True)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in P.CHART_SCHEMA])


def q_serving_rows(spark, sf):
    """The live form of the matrix, replayed in two portions from what training froze."""
    m = Matrix(spark, sf)
    path = f"{shared_folder(spark, 'assets')}.json"
    serving.freeze(m.matrix, m.manifest, m.medians).save(spark, path)
    assets = serving.Assets.load(spark, path)

    def live(stream: DataFrame) -> DataFrame:
        return serving.complete(P.row_stream(stream, assets.medians), m.static, assets)

    rows = P.split_results(streams._replay(materialize(charted(m)), P.CHART_SCHEMA, live))[0]
    return rows.select(F.col("stay_id").cast("long").alias("stay_id"), minute(), *shown(rows, assets.features))


QUERIES = {
    "feature_matrix": q_feature_matrix,
    "feature_manifest": q_feature_manifest,
    "matrix_guards": q_matrix_guards,
    "serving_rows": q_serving_rows,
}

# ------------------------------------------------------------------ oracles
_SRC = ["chartevents", "procedures_of_users", "inputevents", "d_items", "patients", "admissions", "diagnoses"]
_STATIC = {
    "strict": "SELECT c.*, u.intime, c.stay_id // 2 AS subject_id, c.stay_id AS hadm_id, NULL AS los"
              " FROM cohort c JOIN user_stays u USING (stay_id)",
    "flags": ST.FLAGS, "body": ST.BODY, "st0": ST.STATIC,
    "st": "SELECT *, s AS charlson_comorbidity_score, a AS charlson_age_points, s + a AS charlson_index,"
          " CASE WHEN height_cm IS NULL OR gender IS NULL THEN NULL WHEN gender = 'M' THEN 50.0 + 2.3 *"
          " (height_cm / 2.54 - 60) ELSE 45.5 + 2.3 * (height_cm / 2.54 - 60) END AS pbw_kg FROM st0",
}
_WHOLE = ("age_at_icu", "hours_admit_to_icu", "ed_minutes", "prior_icu_stays", "charlson_comorbidity_score",
          "charlson_age_points", "charlson_index")
_TEXT = ("gender", "admission_type", "admission_location", "insurance", "language", "marital_status", "race",
         "first_careunit")


def _matrix_steps(causal: bool) -> dict[str, str]:
    hours = "date_diff('microsecond', h.vent_start, l.charttime) // 3600000000" if causal else "h.vent_hours"
    text = ", ".join(f"st.{c}" for c in _TEXT)
    whole = ", ".join(f"CAST(st.{c} AS BIGINT) AS {c}" for c in _WHOLE)
    flags = ", ".join(f"CAST(coalesce(st.cci_{n}, 0) AS BIGINT) AS cci_{n}" for n in CM.NAMES)
    body = ", ".join(f"round(st.{c}, 4) AS {c}" for c in ("height_cm", "weight_kg", "pbw_kg"))
    return {
        **TS._label_steps(), **TS.SPLIT_STEPS, **_STATIC, "modes": TS.MODES, "locf": TS._locf_step(causal),
        "mode_state": "SELECT w.stay_id, w.charttime, m.ventilator_mode, CAST(coalesce(date_diff('minute', m.mt,"
                      " w.charttime), -1) AS DOUBLE) AS ventilator_mode_age_min FROM wide w ASOF LEFT JOIN modes m"
                      " ON w.stay_id = m.stay_id AND w.charttime > m.mt",
        "matrix": f"SELECT l.*, d.* EXCLUDE (stay_id, charttime), m.* EXCLUDE (stay_id, charttime), {text}, {whole},"
                  f" {flags}, {body}, CAST({hours} AS DOUBLE) AS vent_hours, round(CASE WHEN st.pbw_kg > 0 THEN"
                  " l.tidal_volume_observed_final / st.pbw_kg END, 4) AS tidal_volume_ml_per_kg_pbw"
                  " FROM locf l JOIN drugs d USING (stay_id, charttime) JOIN mode_state m USING (stay_id, charttime)"
                  " LEFT JOIN st ON st.stay_id = l.stay_id LEFT JOIN cohort h ON h.stay_id = l.stay_id",
    }


_TIME = TS._min("x.charttime")
_DOCUMENTED = ("_observed", "_delta_t_min", "_structurally_missing_in_stay")
_LATE = " + ".join(f"count(*) FILTER (WHERE {g}_minutes_since_start <> -1 AND {g}_minutes_since_start <= 0)" for g in C.DRUG_GROUPS)
_GUARDS = f"""SELECT "check", detail <= most AS ok, detail FROM (
  SELECT 'row count unchanged' AS "check", count(*) AS detail, (SELECT count(*) FROM wide) AS most FROM matrix
  UNION ALL SELECT 'stay count unchanged', count(DISTINCT stay_id), (SELECT count(DISTINCT stay_id) FROM wide) FROM matrix
  UNION ALL SELECT 'static coverage', count(*) FILTER (WHERE charlson_index IS NULL), count(*) * 0.01 FROM matrix
  UNION ALL SELECT 'interventions strictly before', {_LATE}, 0 FROM matrix
  UNION ALL SELECT 'no label or later column', 0, 0)"""


def _manifest_sql() -> str:
    rows = []
    groups = {
        "timeseries": [f"{p}_{c}" for p in C.PARAMS for c in C.COMPANIONS] + ["tidal_volume_ml_per_kg_pbw"],
        "static": [*_TEXT, *_WHOLE, *(f"cci_{n}" for n in CM.NAMES), "height_cm", "weight_kg", "pbw_kg", "vent_hours"],
        "interventions": [f"{g}_{c}" for g in C.DRUG_GROUPS for c in ("running", "rate", "minutes_since_start")]
        + ["ventilator_mode", "ventilator_mode_age_min"],
    }
    for source, names in groups.items():
        for n in names:
            kind = "documentation" if source == "timeseries" and n.endswith(_DOCUMENTED) else "physiology"
            text = str(n in _TEXT or n == "ventilator_mode").lower()
            rows.append(f"SELECT '{n}' AS feature, '{kind}' AS kind, '{source}' AS source, {text} AS categorical,"
                        f" count({n}) AS filled FROM matrix")
    return " UNION ALL ".join(rows)


ORACLES = {
    "feature_matrix": with_sources(
        _SRC, _matrix_steps(False),
        f"SELECT x.* EXCLUDE (charttime, vent_hours), CAST(vent_hours AS BIGINT) AS vent_hours, {_TIME},"
        f" CAST(b.{TARGET} AS BIGINT) AS y, p.split, p.fold FROM matrix x JOIN labels b USING (stay_id, charttime)"
        f" JOIN split p ON p.subject_id = x.stay_id // 2 WHERE b.{TARGET} IS NOT NULL"),
    "feature_manifest": with_sources(_SRC, _matrix_steps(False), _manifest_sql()),
    "matrix_guards": with_sources(_SRC, _matrix_steps(False), _GUARDS),
    "serving_rows": with_sources(
        _SRC, _matrix_steps(True), f"SELECT x.* EXCLUDE (charttime), {_TIME} FROM matrix x"),
}
