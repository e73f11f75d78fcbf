"""Registered queries over scored readings: models, records, explanations and their checks.

Models learn the charted warning flag. Records use a fixed linear score, whose attributions
are exact by construction, so every share can be recomputed in SQL.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators import bands, explain, grounding, metrics, models, records, retrieval, split
from ventide.operators.bands import Dwell, Machine
from ventide.plans import text as TX
from ventide.plans import timeseries as TS
from ventide.plans.sources_sql import with_sources
from ventide.plans.timeseries import minute, r
from ventide.session import materialize

NUMERIC = tuple(f"{p}_final" for p in C.PARAMS)
MACHINE = Machine((0.3, 0.5, 0.7), Dwell(30.0, 2, 0.25, 60.0, 240.0))
PROVENANCE = {"model": "linear-reference", "arm": "respiratory", "horizon_hours": 6,
              "label": "warning", "scoring_device": "cpu"}
FEATURES = tuple(f"{p}_{s}" for p in C.PARAMS for s in ("final", "delta_t_min"))
WEIGHTS = {
    **{f"{p}_final": (-1) ** i * 0.02 for i, p in enumerate(C.PARAMS)},
    **{f"{p}_delta_t_min": 0.0005 * (i % 3) for i, p in enumerate(C.PARAMS)},
}
BIAS = -0.5
KINDS = {f: (("documentation", "timeseries") if f.endswith("delta_t_min")
             else ("physiology", "timeseries")) for f in FEATURES}


def imputed(spark, sf) -> DataFrame:
    return materialize(TS.imputed_of(materialize(TS.wide(spark, sf))))


def training(spark, sf) -> DataFrame:
    carried = imputed(spark, sf)
    folds = split.place(split.patient_summary(carried).withColumn(
        "strat", split.stratum(F.col("n_pos") / F.col("n_rows"))))
    return materialize(carried.join(folds.select("subject_id", "split", "fold"), "subject_id")
                       .withColumn("y", F.col("warning").cast("double")))


def _model(df: DataFrame):
    return models.fit_gbt(df, NUMERIC, maxIter=5, maxDepth=3)


def q_model_metrics(spark, sf):
    df = training(spark, sf)
    held = models.score(_model(df), df.where("split = 'test'"), NUMERIC)
    out = metrics.rank_metrics(held.select("y", "p"))
    return out.select("rows", r("positive_rate", 6), r("ap", 6), r("auc", 6), r("brier", 6))


def q_calibration(spark, sf):
    df = training(spark, sf)
    held = materialize(models.score(_model(df), df.where("fold = 4 OR split = 'test'"), NUMERIC)
                       .select("y", "p", "split"))
    return models.calibration_report(held.where("split = 'train'"), held.where("split = 'test'"))


def q_attribution(spark, sf):
    """Rows whose exact attributions add up to the model's log-odds."""
    df = training(spark, sf)
    model = _model(df)
    explained = models.attribute(model, models.score(model, df, NUMERIC))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c) + F.col("bias")
    return explained.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(metrics.sigmoid(total) - F.col("p")) < 1e-6).alias("reconstructed"))


def q_importance(spark, sf):
    rows = models.importance_by_group(_model(training(spark, sf)), NUMERIC,
                                      dict.fromkeys(NUMERIC, "timeseries"))
    return spark.createDataFrame(rows)


def q_ablation(spark, sf):
    df = training(spark, sf)
    sets = {"final": NUMERIC, "documentation": tuple(f"{p}_observed" for p in C.PARAMS)}
    return spark.createDataFrame(models.ablation(df, sets, maxIter=3, maxDepth=3))


def q_grouped_cv(spark, sf):
    grid = [{"maxIter": 3, "maxDepth": 2}, {"maxIter": 3, "maxDepth": 3}]
    return spark.createDataFrame(models.grouped_cv(training(spark, sf), NUMERIC, grid))


def q_legacy_chain(spark, sf):
    df = training(spark, sf)
    out = models.legacy_chain(df.where("split = 'train'"), df.where("split = 'test'"), NUMERIC,
                              ["stay_id", "charttime"], trees=5)
    return metrics.rank_metrics(out).select("rows", r("ap", 6), r("auc", 6))


def scored(spark, sf) -> DataFrame:
    """Readings with linear contributions, their score and band view."""
    carried = imputed(spark, sf)
    parts = [F.coalesce(F.col(f), F.lit(0.0)) * F.lit(WEIGHTS[f]) for f in FEATURES]
    df = carried.withColumns({"contributions": F.array(*parts), "bias": F.lit(BIAS)})
    # A plain sum, so that it is compiled; a sum over the array would be interpreted.
    total = reduce(add, parts, F.lit(0.0)) + F.lit(BIAS)
    # The bands read keys and scores only; the wide rows are written once, with their bands.
    df = df.withColumn("p", metrics.sigmoid(total))
    views = bands.band_views(materialize(df.select("stay_id", "charttime", "p")), MACHINE)
    return materialize(df.join(views.drop("p"), ["stay_id", "charttime"]))


def record_set(spark, sf) -> DataFrame:
    """The records, written once for those who read them more than once."""
    return materialize(built_records(spark, sf))


def built_records(spark, sf) -> DataFrame:
    df = scored(spark, sf)
    meta = df.groupBy("displayed").agg(F.avg("warning").alias("observed_rate")).select(
        "displayed", F.round("observed_rate", 4).alias("observed_rate"),
        F.round(F.greatest(F.col("observed_rate") - 0.02, F.lit(0.0)), 4).alias("lo"),
        F.round(F.least(F.col("observed_rate") + 0.02, F.lit(1.0)), 4).alias("hi"))
    base = df.agg(F.avg("warning")).first()[0]
    return records.build_records(
        df, FEATURES, KINDS, meta, max(round(float(base), 4), 1e-4), PROVENANCE)


def q_record_shares(spark, sf):
    out = built_records(spark, sf)
    return out.select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(),
        F.col("contributors")[0]["feature"].alias("top_feature"), "documentation_share",
        "imputed_share", "attribution_total", "attribution_age_min", "contributors_other")


def q_records(spark, sf):
    out = built_records(spark, sf)
    body = F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"})
    return out.select(F.col("stay_id").cast("long").alias("stay_id"), minute(), body.alias("record"))


def q_record_checks(spark, sf):
    return records.record_checks(record_set(spark, sf))


def q_top_features(spark, sf):
    return records.top_feature_counts(record_set(spark, sf))


def q_explanations(spark, sf):
    out = explain.explanations(record_set(spark, sf))
    return out.select(F.col("stay_id").cast("long").alias("stay_id"), minute(), "status", "text",
                      F.array_join("reasons", ",").alias("reasons"))


def q_gate_reasons(spark, sf):
    out = explain.explanations(record_set(spark, sf), generator=None)
    return out.groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(
        F.count(F.lit(1)).alias("readings"))


def q_explanation_checks(spark, sf):
    found = record_set(spark, sf)
    return explain.explanation_checks(found, explain.explanations(found))


def guideline_passages(spark, sf) -> DataFrame:
    """The passages of the corpus that each configured key finds."""
    return TX.evidence(spark, sf, retrieval.key_table(spark))[2]


def checked(spark, sf) -> DataFrame:
    """Texts and their findings, against the record and the passages that go with the reading."""
    # Written once, with the text: every check reads it, and it is built from the whole record. Records
    # that are refused have no text, so they are not built.
    texts = materialize(explain.with_outcome(built_records(spark, sf)).where("status = 'ok'"))
    passage = F.get(grounding.prepared(F.array(F.struct("text", "citation"))), F.lit(0))
    passages = guideline_passages(spark, sf).withColumn("passage", passage)
    return grounding.check(explain.with_context(texts, passages))


def q_grounding(spark, sf):
    """Findings in the template texts per code: violations would be template defects."""
    graded = checked(spark, sf).select(
        F.coalesce(grounding.worst(F.col("findings")), F.lit("clean")).alias("worst"))
    return graded.groupBy("worst").agg(F.count(F.lit(1)).alias("texts"))


def q_evidence_selection(spark, sf):
    """Passages attached per reading, from the parameter display table as evidence."""
    found = record_set(spark, sf)
    rows = []
    for p, (label, *_rest) in C.PARAM_DISPLAY.items():
        rows.append((f"context:{p}", 1, f"c-{p}", f"{label} is defined.", "Guideline A, p.1"))
        for band in C.BAND_NAMES:
            rows.append((f"action:{band}:{p}", 1, f"c-{p}", f"{label} is defined.", "Guideline A, p.1"))
            rows.append((f"action:{band}:{p}", 2, f"a-{band}-{p}", f"Check {label}.", "Guideline A, p.2"))
    evidence = spark.createDataFrame(
        rows, "key string, rank int, chunk_id string, text string, citation string")
    out = explain.select_evidence(found, evidence)
    return out.groupBy("channel", "n", "chunk_id").agg(F.count(F.lit(1)).alias("readings"))


QUERIES = {
    "model_metrics": q_model_metrics,
    "calibration_report": q_calibration,
    "model_attribution": q_attribution,
    "feature_importance": q_importance,
    "feature_ablation": q_ablation,
    "grouped_cv": q_grouped_cv,
    "legacy_chain": q_legacy_chain,
    "record_shares": q_record_shares,
    "risk_records": q_records,
    "record_checks": q_record_checks,
    "top_features": q_top_features,
    "explanations": q_explanations,
    "gate_reasons": q_gate_reasons,
    "explanation_checks": q_explanation_checks,
    "grounding": q_grounding,
    "evidence_selection": q_evidence_selection,
}


def _share_steps() -> dict[str, str]:
    frame = "OVER (PARTITION BY stay_id ORDER BY charttime ROWS UNBOUNDED PRECEDING)"
    inner = ", ".join(
        f"last_value({p} IGNORE NULLS) {frame} AS v_{p}, last_value(CASE WHEN {p} IS NOT NULL THEN"
        f" charttime END IGNORE NULLS) {frame} AS t_{p}" for p in C.PARAMS)
    ages = ", ".join(f"date_diff('microsecond', t_{p}, charttime) / 60000000.0 AS {p}_age"
                     for p in C.PARAMS)
    medians = "SELECT " + ", ".join(f"median({p}) AS {p}" for p in C.PARAMS) + (
        " FROM wide JOIN split USING (subject_id) WHERE split = 'train'")
    finals = ", ".join(
        f"CASE WHEN {p}_age <= 240 THEN v_{p} END AS {p}_locf,"
        f" coalesce(CASE WHEN {p}_age <= 240 THEN v_{p} END, m.{p}) AS {p}_final" for p in C.PARAMS)
    items = ", ".join(
        f"{{'f': '{p}_final', 'c': coalesce({p}_final, 0) * {WEIGHTS[f'{p}_final']!r}}},"
        f" {{'f': '{p}_delta_t_min', 'c': coalesce({p}_age, 0) * {WEIGHTS[f'{p}_delta_t_min']!r}}}"
        for p in C.PARAMS)
    size = " + ".join(f"abs(coalesce({p}_final, 0) * {WEIGHTS[f'{p}_final']!r})" for p in C.PARAMS)
    doc = " + ".join(f"abs(coalesce({p}_age, 0) * {WEIGHTS[f'{p}_delta_t_min']!r})" for p in C.PARAMS)
    imp = " + ".join(
        f"CASE WHEN {p}_locf IS NULL THEN abs(coalesce({p}_final, 0) * {WEIGHTS[f'{p}_final']!r})"
        " ELSE 0 END" for p in C.PARAMS)
    aged = " + ".join(f"coalesce(abs(coalesce({p}_final, 0) * {WEIGHTS[f'{p}_final']!r}) * {p}_age, 0)"
                      for p in C.PARAMS)
    weighed = " + ".join(
        f"CASE WHEN {p}_age IS NOT NULL THEN abs(coalesce({p}_final, 0) * {WEIGHTS[f'{p}_final']!r})"
        " ELSE 0 END" for p in C.PARAMS)
    return {
        **TS.SPLIT_STEPS,
        "med": medians,
        "aged": f"SELECT *, {ages} FROM (SELECT *, {inner} FROM wide)",
        "fin": f"SELECT a.stay_id, a.charttime, {', '.join(f'{p}_age' for p in C.PARAMS)}, {finals}"
               " FROM aged a, med m",
        "shares": f"SELECT stay_id, charttime, [{items}] AS items, {size} + {doc} AS total,"
                  f" {doc} AS doc, {imp} AS imp, {aged} AS ag, {weighed} AS wt FROM fin",
        "ranked": "SELECT *, list_sort(list_transform(items, lambda x: {'a': -abs(x.c), 'f': x.f,"
                  " 'c': x.c})) AS s FROM shares",
    }


ORACLES = {
    "record_shares": with_sources(
        TS._SRC, _share_steps(),
        f"SELECT stay_id, {TS._min('charttime')}, s[1].f AS top_feature,"
        " round(doc / total, 4) AS documentation_share, round(imp / total, 4) AS imputed_share,"
        " round(total, 8) AS attribution_total,"
        " round(CASE WHEN wt > 0 THEN ag / wt END, 4) AS attribution_age_min,"
        " round(list_sum(list_transform(s[9:], lambda x: x.c)), 8) AS contributors_other"
        " FROM ranked"),
    "top_features": with_sources(
        TS._SRC, _share_steps(),
        "SELECT s[1].f AS feature, count(*) AS readings FROM ranked GROUP BY ALL"),
    "gate_reasons": with_sources(
        TS._SRC, _share_steps(),
        "SELECT CASE WHEN i OR d THEN 'insufficient_data' ELSE 'generator_unavailable' END AS status,"
        " concat_ws(',', CASE WHEN i THEN 'IMPUTED_SHARE_ABOVE_FLOOR' END,"
        " CASE WHEN d THEN 'DOC_SHARE_ABOVE_FLOOR' END) AS reasons, count(*) AS readings FROM"
        " (SELECT round(imp / total, 4) > 0.3 AS i, round(doc / total, 4) > 0.3 AS d FROM ranked)"
        " GROUP BY ALL"),
}
