"""Registered queries over scored rows: metrics, bootstrap and risk bands.

Scored rows come from `lineitem` (label: returned; score: price and discount terms; patient:
supplier; stay: order). Banded readings come from `events` (score: a saturating value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.quantile import quantiles
from ventide.functions.timefn import micros
from ventide.operators import bands, bootstrap, metrics, split, sweep
from ventide.operators.bands import Dwell, Machine
from ventide.plans.sources_sql import with_sources
from ventide.plans.timeseries import minute, r
from ventide.session import materialize
from ventide.sources import testdata as TD

MACHINE = Machine((0.35, 0.55, 0.8), Dwell(30.0, 2, 0.25, 60.0, 240.0))
REPLICATES = 200

_SCORED = (
    "l_suppkey AS subject_id", "l_orderkey AS stay_id", "l_shipdate AS charttime",
    "if(l_returnflag = 'R', 1, 0) AS y",
    "round(l_extendedprice / (l_extendedprice + 50000), 4) AS p",
    "round(least(l_discount * 6 + l_tax, 0.99), 4) AS q",
)


def scored(spark, sf) -> DataFrame:
    return TD.table(spark, sf, "lineitem").selectExpr(*_SCORED)


def readings(spark, sf) -> DataFrame:
    """One scored reading per stay and minute."""
    return TD.events(spark, sf).groupBy("stay_id", "charttime").agg(
        F.round(F.max("v") / (F.max("v") + 60), 4).alias("p"),
        F.max((F.col("k") % 4 == 0).cast("int")).alias("y"),
    )


def q_rank_metrics(spark, sf):
    out = metrics.rank_metrics(scored(spark, sf))
    return out.select("rows", *[r(c, 6) for c in out.columns if c != "rows"])


def q_rank_metrics_by_group(spark, sf):
    grouped = scored(spark, sf).withColumn("grp", F.col("subject_id") % 5)
    out = metrics.rank_metrics(grouped, ("grp",))
    return out.select("grp", "rows", r("ap", 6), r("auc", 6), r("brier", 6))


def q_reliability(spark, sf):
    out = metrics.reliability(scored(spark, sf))
    return out.select(F.col("bin").cast("long").alias("bin"), "n", r("mean_predicted", 6),
                      r("observed", 6))


def q_level_metrics(spark, sf):
    out = metrics.level_metrics(scored(spark, sf))
    return out.select(*[r(c, 6) for c in out.columns])


def q_operating_points(spark, sf):
    marks = spark.createDataFrame([(t / 10,) for t in range(1, 9)], "threshold double")
    out = metrics.operating_points(scored(spark, sf), marks)
    return out.select("threshold", "alert_hours",
                      *[r(c, 6) for c in ("rows_flagged_pct", "sensitivity", "ppv",
                                          "alerts_per_24h")])


def q_threshold_budget(spark, sf):
    out = metrics.thresholds_for_budgets(scored(spark, sf), (2.0, 8.0, 16.0))
    return out.select("budget", "reachable", r("threshold", 6), r("alerts_per_24h", 6),
                      r("sensitivity", 6))


def q_kappa(spark, sf):
    flags = scored(spark, sf).select(F.col("y").alias("a"), (F.col("p") > 0.5).cast("int").alias("b"))
    return metrics.kappa(flags, "a", "b").select(
        "both", "only_a", "only_b", "neither", r("kappa", 6), r("jaccard", 6))


def q_kappa_labels(spark, sf):
    """Agreement of the two document labels."""
    return metrics.kappa(TD.table(spark, sf, "labels"), "quality", "toxic").select(
        "both", "only_a", "only_b", "neither", r("kappa", 6), r("jaccard", 6))


def q_coverage(spark, sf):
    return metrics.coverage(scored(spark, sf)).select(
        "stays", "stays_with_positive", "rows", "positives", r("monitored_days", 4),
        r("positives_per_day", 4))


def q_score_quantiles(spark, sf):
    out = quantiles(scored(spark, sf), ["y"], "q", [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.select(F.col("y").cast("long").alias("y"), "fraction", r("quantile", 6))


def q_ap_bootstrap(spark, sf):
    rows = bootstrap.ordered_metrics(scored(spark, sf), "p", "subject_id", REPLICATES)
    return rows.select(F.col("rep").cast("long").alias("rep"), r("ap", 6))


def q_metric_bootstrap(spark, sf):
    """AP, AUC, Brier score and ECE of every replicate, from one ordered pass."""
    rows = bootstrap.ordered_metrics(scored(spark, sf), "p", "subject_id", REPLICATES)
    return rows.select(F.col("rep").cast("long").alias("rep"), *[r(m, 6) for m in bootstrap.METRICS])


def q_metric_intervals(spark, sf):
    out = bootstrap.metric_intervals(scored(spark, sf), "q", "subject_id", REPLICATES)
    return out.select("metric", r("mean", 6), r("lo", 6), r("hi", 6), "resamples")


def q_metric_differences(spark, sf):
    out = bootstrap.metric_differences(scored(spark, sf), "p", "q", "subject_id", REPLICATES)
    return out.select("metric", r("mean", 6), r("lo", 6), r("hi", 6), "resamples", r("p_worse", 6))


def q_ap_difference(spark, sf):
    out = bootstrap.ap_difference(scored(spark, sf), "p", "q", "subject_id", REPLICATES)
    return out.select(r("mean", 6), r("lo", 6), r("hi", 6), "resamples", r("p_worse", 6))


def q_brier_difference(spark, sf):
    out = bootstrap.brier_difference(scored(spark, sf), "p", "q", "subject_id", 200)
    return out.select(r("mean", 6), r("lo", 6), r("hi", 6), "resamples", r("p_worse", 6))


def q_balanced_sample(spark, sf):
    """Class-balanced draw (the sampling operator itself)."""
    rows = TD.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS row_id", "l_partkey", "l_suppkey",
        "if(l_returnflag = 'R', 1, 0) AS y")
    out = split.balanced_sample(rows, "y", ["row_id", "l_partkey", "l_suppkey"])
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("ids"))


def q_stratified_sample(spark, sf):
    """Up to ten readings per band, at most one per stay and band."""
    banded = readings(spark, sf).select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(),
        bands.instant_band(MACHINE, F.col("p")).cast("long").alias("band"))
    return split.sample_per_class(banded, "band", "stay_id", ["stay_id", "charttime"], 10)


def q_instant_bands(spark, sf):
    rows = scored(spark, sf).select(bands.instant_band(MACHINE, F.col("p")).alias("i"), "y")
    return rows.groupBy(bands.band_name(MACHINE, F.col("i")).alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"))


def q_band_views(spark, sf):
    out = bands.band_views(materialize(readings(spark, sf)), MACHINE)
    return out.select(
        F.col("stay_id").cast("long").alias("stay_id"), minute(), "instant", "displayed",
        "band_state", "readings_in_state")


def banded(spark, sf) -> DataFrame:
    return materialize(bands.displayed(materialize(readings(spark, sf)), MACHINE))


def q_band_evaluation(spark, sf):
    out = bands.evaluate(banded(spark, sf), MACHINE)
    return out.select(*[r(c, 6) for c in out.columns])


def q_band_table(spark, sf):
    return bands.band_table(banded(spark, sf), MACHINE).select(
        "band", "rows", r("share", 6), r("observed_rate", 6))


def q_band_ratchet(spark, sf):
    out = bands.ratchet(banded(spark, sf), MACHINE)
    return out.select(F.col("quartile").cast("long").alias("quartile"), "stays", "rows",
                      r("displayed", 6), r("instant", 6), r("ratio", 6))


def q_band_envelope(spark, sf):
    out = bootstrap.band_rates(banded(spark, sf), "stay_id", "displayed_index", "y", 400)
    return out.select(F.col("displayed_index").cast("long").alias("displayed_index"), "resamples",
                      *[r(c, 6) for c in ("mean", "lo", "hi", "envelope_lo", "envelope_hi")])


def q_patient_days(spark, sf):
    return bands.patient_days(readings(spark, sf)).select(r("days", 6))


def q_charting_gaps(spark, sf):
    out = bands.charting_gaps(materialize(readings(spark, sf)))
    return out.select(*[r(c, 4) for c in out.columns])


def q_promotion_profile(spark, sf):
    """Promotions at seven quantiles of the score: the rate rises and falls along it."""
    base = materialize(readings(spark, sf))
    marks = quantiles(base, [], "p", list(C.RATE_QUANTILES)).collect()  # seven rows
    cuts = {f"c{round(100 * m['fraction'])}": round(m["quantile"], 4) for m in marks}
    out = bands.rate_profile(base, cuts, 0.0, MACHINE.dwell)
    return out.select("latch", r("promotions_per_day", 6))


SWEPT = Dwell(30.0, 2, 0.25, 60.0)
# Promotions a day that bind on these readings; the configured budgets belong to another score.
BUDGETS = (0.9, 0.5, 0.2)


def q_solved_cuts(spark, sf):
    """Cuts of one setting, solved from the lowest up on the whole grid."""
    base = materialize(readings(spark, sf))
    result = sweep.solve(sweep.chunked(base, [SWEPT]), bands.score_grid(base), bands.patient_days(base).first()["days"],
                         [SWEPT], BUDGETS)[0]
    rows = [(n, *(float(s[c]) for c in ("cut", "promotions_per_day", "budget", "cut_just_below", "rate_just_below")))
            for n, s in zip(C.BAND_NAMES[1:], result["solved"])]
    out = spark.createDataFrame(rows, "band string, cut double, promotions_per_day double, budget double,"
                                      " cut_just_below double, rate_just_below double")
    return out.select("band", "budget", *[r(c, 6) for c in ("cut", "promotions_per_day", "cut_just_below", "rate_just_below")])


def q_band_sweep(spark, sf):
    """Every hysteresis setting at the same cuts: what the machine alone does."""
    base = materialize(readings(spark, sf))
    dwells = bands.sweep_dwells()
    out = sweep.evaluate(base, sweep.chunked(base, dwells), [Machine(MACHINE.cuts, d) for d in dwells])
    labels = F.array(*[F.lit(d.label) for d in dwells])
    return out.select(F.get(labels, F.col("setting")).alias("setting"), r("flips_per_day", 6), r("sensitivity_high", 6),
                      r("lost_lead_median_min", 4), r("lost_lead_p90_min", 4), r("lost_lead_median_min_positive", 4))


def q_band_choice(spark, sf):
    """Every setting with cuts solved for it, and the one chosen."""
    results = sweep.sweep(readings(spark, sf), bands.sweep_dwells(), BUDGETS)
    columns = ("flips_per_day", "sensitivity_high", "lost_lead_median_min", "lost_lead_p90_min", "lost_lead_median_min_positive")
    rows = [(x["dwell"].label, x["rejected"], x.get("chosen", False), [float(s["cut"]) for s in x["solved"]],
             *(None if x.get(c) is None else float(x[c]) for c in columns)) for x in results]
    out = spark.createDataFrame(rows, "setting string, rejected string, chosen boolean, cuts array<double>, "
                                + ", ".join(f"{c} double" for c in columns))
    return out.select("setting", "rejected", "chosen", F.array_join(F.transform("cuts", lambda c: F.format_number(c, 4)), "/")
                      .alias("cuts"), *[r(c, 6) for c in columns])


QUERIES = {
    "rank_metrics": q_rank_metrics,
    "rank_metrics_by_group": q_rank_metrics_by_group,
    "reliability_bins": q_reliability,
    "level_metrics": q_level_metrics,
    "operating_points": q_operating_points,
    "threshold_for_budget": q_threshold_budget,
    "kappa_jaccard": q_kappa,
    "kappa_labels": q_kappa_labels,
    "label_coverage": q_coverage,
    "score_quantiles": q_score_quantiles,
    "ap_bootstrap": q_ap_bootstrap,
    "metric_bootstrap": q_metric_bootstrap,
    "metric_intervals": q_metric_intervals,
    "metric_differences": q_metric_differences,
    "ap_difference": q_ap_difference,
    "brier_difference": q_brier_difference,
    "balanced_sample": q_balanced_sample,
    "stratified_sample": q_stratified_sample,
    "instant_bands": q_instant_bands,
    "band_views": q_band_views,
    "band_evaluation": q_band_evaluation,
    "band_table": q_band_table,
    "band_ratchet": q_band_ratchet,
    "band_envelope": q_band_envelope,
    "patient_days": q_patient_days,
    "charting_gaps": q_charting_gaps,
    "promotion_profile": q_promotion_profile,
    "solved_cuts": q_solved_cuts,
    "band_sweep": q_band_sweep,
    "band_choice": q_band_choice,
}

# ------------------------------------------------------------------ oracles
SCORED = """SELECT l_suppkey AS subject_id, l_orderkey AS stay_id, l_shipdate AS charttime,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  round(l_extendedprice / (l_extendedprice + 50000), 4) AS p,
  round(least(l_discount * 6 + l_tax, 0.99), 4) AS q FROM lineitem"""
READINGS = """SELECT stay_id, charttime, round(max(v) / (max(v) + 60), 4) AS p,
  max(CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) AS y FROM ev GROUP BY stay_id, charttime"""


def _s(steps: dict[str, str], final: str) -> str:
    return with_sources([], {"scored": SCORED, **steps}, final)


def _rank_sql(group: str) -> str:
    by = f"{group}," if group else ""
    part = f"PARTITION BY {group}" if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""SELECT {by} CAST(sum(n) AS BIGINT) AS rows,
      round(sum(pos) / sum(n), 6) AS positive_rate,
      round(sum(pos * tp / seen) / sum(pos), 6) AS ap,
      round(sum((n - pos) * (tp - pos / 2.0)) / (sum(pos) * sum(n - pos)), 6) AS auc,
      round(sum(pos * (1 - p) ** 2 + (n - pos) * p ** 2) / sum(n), 6) AS brier,
      round(sum(p * n) / sum(n), 6) AS mean_predicted
      FROM (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp
            FROM (SELECT {by} p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY {by} p)
            WINDOW w AS ({part} ORDER BY p DESC)){tail}"""


_EDGES = ", ".join(f"{i}.0 / 15" for i in range(1, 15))
BINS = f"""SELECT bin, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed FROM (
  SELECT *, len(list_filter((SELECT quantile_cont(p, [{_EDGES}]) FROM scored), lambda e: e <= p)) AS bin
  FROM scored) GROUP BY bin"""

_OP = """SELECT t AS threshold, hours_on AS alert_hours,
  round(100.0 * flagged / n, 6) AS rows_flagged_pct,
  round(hit / greatest(pos, 1), 6) AS sensitivity,
  round(hit / greatest(flagged, 1), 6) AS ppv,
  round(24.0 * hours_on / greatest(hours, 1), 6) AS alerts_per_24h"""
OP_STEPS = {
    "hours": "SELECT stay_id, date_trunc('hour', charttime) AS h, max(p) AS p FROM scored"
             " GROUP BY ALL",
}


def _op(marks: str) -> str:
    return f"""SELECT t, count(*) AS n, sum(y) AS pos, count(*) FILTER (WHERE p > t) AS flagged,
      coalesce(sum(y) FILTER (WHERE p > t), 0) AS hit,
      (SELECT count(*) FROM hours) AS hours,
      (SELECT count(*) FROM hours h WHERE h.p > t) AS hours_on
      FROM scored, ({marks}) GROUP BY t"""


_GRID = ", ".join(f"{i}.0 / 399" for i in range(400))
BUDGET_STEPS = {
    **OP_STEPS,
    "marks": f"SELECT DISTINCT unnest(quantile_cont(p, [{_GRID}])) AS t FROM scored",
    "score_counts": "SELECT p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY p",
    "hour_counts": "SELECT p, count(*) AS n FROM hours GROUP BY p",
    "points": """SELECT t, 24.0 * (SELECT coalesce(sum(n), 0) FROM hour_counts h WHERE h.p > t)
        / (SELECT sum(n) FROM hour_counts) AS a,
        (SELECT coalesce(sum(pos), 0) FROM score_counts s WHERE s.p > t)
        / (SELECT sum(pos) FROM score_counts) AS s FROM marks""",
}
_BUDGET = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {b} AS budget, a <= {b} AS reachable, round(t, 6) AS threshold,"
    f" round(a, 6) AS alerts_per_24h, round(s, 6) AS sensitivity FROM points"
    f" ORDER BY a <= {b} DESC, CASE WHEN a <= {b} THEN t ELSE -t END LIMIT 1)"
    for b in ("2.0::DOUBLE", "8.0::DOUBLE", "16.0::DOUBLE")
)


def _kappa(a: str, b: str, table: str) -> str:
    return f"""SELECT "both", only_a, only_b, neither,
      round((("both" + neither) / n - e) / (1 - e), 6) AS kappa,
      round("both" / ("both" + only_a + only_b), 6) AS jaccard FROM (
      SELECT *, (("both" + only_a) / n) * (("both" + only_b) / n)
             + ((only_b + neither) / n) * ((only_a + neither) / n) AS e FROM (
        SELECT count(*) FILTER (WHERE {a} AND {b}) AS "both",
               count(*) FILTER (WHERE {a} AND NOT {b}) AS only_a,
               count(*) FILTER (WHERE NOT {a} AND {b}) AS only_b,
               count(*) FILTER (WHERE NOT {a} AND NOT {b}) AS neither, count(*) AS n
        FROM {table}))"""


_CDF = bootstrap.POISSON_CDF


def _draw(*ids: str) -> str:
    text = " || '|' || ".join(ids)
    u = f"CAST('0x' || substr(md5('42|' || {text}), 1, 12) AS BIGINT) / 281474976710656.0"
    return "(" + " + ".join(f"CASE WHEN {u} >= {p!r} THEN 1 ELSE 0 END" for p in _CDF) + ")"


def _ap_reps(score: str) -> str:
    return f"""SELECT rep, sum(pos * tp / seen) / sum(pos) AS ap FROM (
      SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp FROM (
        SELECT rep, {score} AS p, sum(wt) AS n, sum(wt * y) AS pos FROM scored
        JOIN weights USING (subject_id) WHERE wt > 0 GROUP BY ALL)
      WINDOW w AS (PARTITION BY rep ORDER BY p DESC)) GROUP BY rep"""


def _weights(n: int, key: str, table: str) -> str:
    return (f"SELECT rep, {key}, {_draw('rep', key)} AS wt FROM (SELECT DISTINCT {key} FROM {table}),"
            f" (SELECT unnest(range({n})) AS rep)")


def _metric_reps(score: str) -> dict[str, str]:
    """Rank metrics from sums per score; bins of each resample from the resampled rows themselves."""
    grid = ", ".join(f"{i}.0 / 15" for i in range(1, 15))
    return {
        f"c_{score}": f"SELECT rep, {score} AS p, sum(wt) AS n, sum(wt * y) AS pos FROM scored"
                      " JOIN weights USING (subject_id) WHERE wt > 0 GROUP BY ALL",
        f"r_{score}": f"SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp FROM c_{score}"
                      " WINDOW w AS (PARTITION BY rep ORDER BY p DESC)",
        f"e_{score}": f"SELECT rep, quantile_cont(p, [{grid}]) AS e FROM c_{score}, unnest(range(CAST(n AS BIGINT))) GROUP BY rep",
        f"b_{score}": f"SELECT rep, sum(abs(gap)) AS gaps FROM (SELECT rep, len(list_filter(e, lambda x: x <= p)) AS bin,"
                      f" sum(n * p - pos) AS gap FROM c_{score} JOIN e_{score} USING (rep) GROUP BY ALL) GROUP BY rep",
        f"m_{score}": "SELECT rep, sum(pos * tp / seen) / sum(pos) AS ap, sum((n - pos) * (tp - pos / 2.0)) / (sum(pos) *"
                      " sum(n - pos)) AS auc, sum(pos * (1 - p) ** 2 + (n - pos) * p ** 2) / sum(n) AS brier,"
                      f" any_value(gaps) / sum(n) AS ece FROM r_{score} JOIN b_{score} USING (rep) GROUP BY rep",
        f"l_{score}": f"UNPIVOT m_{score} ON ap, auc, brier, ece INTO NAME metric VALUE v",
    }


_CI = ("round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.025), 6) AS lo,"
       " round(quantile_cont({v}, 0.975), 6) AS hi, count(*) AS resamples")


def _latch_steps(machine: Machine = MACHINE, prefix: str = "") -> dict[str, str]:
    """The latches one reading at a time, as a recursive query."""
    d = machine.dwell
    rules = ", ".join(f"({k}, {c}, {f})" for k, (c, f) in
                      enumerate(zip(machine.cuts, machine.floors, strict=True)))
    return {
        f"{prefix}seq": "SELECT *, row_number() OVER w AS rn, epoch_us(charttime) / 60000000.0 AS t,"
               " (epoch_us(charttime) - lag(epoch_us(charttime)) OVER w) / 60000000.0 AS gap"
               " FROM readings WINDOW w AS (PARTITION BY stay_id ORDER BY charttime)",
        f"{prefix}latch": f"""
          SELECT stay_id, k, cut, flr, CAST(0 AS BIGINT) AS rn, false AS lit,
                 CAST(NULL AS DOUBLE) AS since, 0 AS cnt
          FROM (SELECT DISTINCT stay_id FROM {prefix}seq), (VALUES {rules}) v(k, cut, flr)
          UNION ALL
          SELECT stay_id, k, cut, flr, rn, lit <> fire,
                 CASE WHEN mv AND NOT fire THEN s1 END, CASE WHEN mv AND NOT fire THEN c1 ELSE 0 END
          FROM (SELECT *, mv AND t - s1 >= CASE WHEN lit THEN {d.demote_min} ELSE {d.promote_min} END
                       AND (lit OR c1 >= {d.promote_readings}) AS fire
                FROM (SELECT l.stay_id, l.k, l.cut, l.flr, s.rn, l.lit, s.t,
                        CASE WHEN l.lit THEN s.p < l.flr ELSE s.p > l.cut END AS mv,
                        coalesce(CASE WHEN s.gap > {d.max_gap_min} THEN NULL ELSE l.since END, s.t)
                          AS s1,
                        CASE WHEN s.gap > {d.max_gap_min} THEN 0 ELSE l.cnt END + 1 AS c1
                      FROM {prefix}latch l JOIN {prefix}seq s
                        ON s.stay_id = l.stay_id AND s.rn = l.rn + 1))""",
        f"{prefix}banded": f"""SELECT s.*, sum(CASE WHEN lit THEN 1 ELSE 0 END) AS shown,
              sum(CASE WHEN s.p > cut THEN 1 ELSE 0 END) AS inst
            FROM {prefix}latch l JOIN {prefix}seq s USING (stay_id, rn) GROUP BY ALL""",
    }


def _b(steps: dict[str, str], final: str, machine: Machine = MACHINE) -> str:
    text = with_sources(["ev"], {"readings": READINGS, **_latch_steps(machine), **steps}, final)
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


_NAME = "(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[CAST({0} AS INTEGER) + 1]"
_EVAL_STEPS = {
    "lagged": "SELECT *, lag(shown) OVER (PARTITION BY stay_id ORDER BY charttime) AS before"
              " FROM banded",
    "lost": "SELECT date_diff('microsecond', min(charttime) FILTER (WHERE inst >= 2),"
            " coalesce(min(charttime) FILTER (WHERE shown >= 2), max(charttime))) / 60000000.0 AS x"
            " FROM banded GROUP BY stay_id HAVING max(inst) >= 2",
    "days": "SELECT count(*) / 24.0 AS d FROM (SELECT DISTINCT stay_id,"
            " date_trunc('hour', charttime) FROM readings)",
}
_EVAL = """SELECT round((SELECT count(*) FROM lagged WHERE before <> shown) / (SELECT d FROM days), 6)
    AS flips_per_day,
  round((SELECT count(*) FILTER (WHERE shown >= 2) / count(*) FROM banded WHERE y = 1), 6)
    AS sensitivity_high,
  round((SELECT quantile_cont(x, 0.5) FROM lost), {0}) AS lost_lead_median_min,
  round((SELECT quantile_cont(x, 0.9) FROM lost), {0}) AS lost_lead_p90_min"""


def _profile_sql() -> str:
    d = MACHINE.dwell
    steps = _latch_steps()
    known = ", ".join(f"({k}, {c}, {f})" for k, (c, f) in
                      enumerate(zip(MACHINE.cuts, MACHINE.floors, strict=True)))
    steps["latch"] = steps["latch"].replace(f"(VALUES {known}) v(k, cut, flr)", "marks v")
    steps.pop("banded")
    marks = " UNION ALL ".join(
        f"SELECT {round(100 * q)} AS k, round(quantile_cont(p, {q}), 4) AS cut FROM readings" for q in C.RATE_QUANTILES)
    text = with_sources(["ev"], {
        "readings": READINGS, "marks": f"SELECT k, cut, cut - {d.demote_margin} * cut AS flr FROM ({marks})",
        **steps, "days": _EVAL_STEPS["days"],
        "edges": "SELECT k, lit, lag(lit) OVER (PARTITION BY stay_id, k ORDER BY rn) AS before"
                 " FROM latch"},
        "SELECT 'c' || k AS latch, round(count(*) FILTER (WHERE lit AND NOT before)"
        " / (SELECT d FROM days), 6) AS promotions_per_day FROM edges GROUP BY k")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _sweep_sql() -> str:
    """All settings as rules of one recursive query, one reading at a time."""
    rules = []
    for i, d in enumerate(bands.sweep_dwells()):
        m = Machine(MACHINE.cuts, d)
        rules += [f"({i}, '{d.label}', {k}, {c}, {f}, {d.promote_min}, {d.promote_readings}, {d.demote_min})"
                  for k, (c, f) in enumerate(zip(m.cuts, m.floors, strict=True))]
    gap = MACHINE.dwell.max_gap_min
    text = with_sources(["ev"], {
        "readings": READINGS,
        "rules": f"SELECT * FROM (VALUES {', '.join(rules)}) v(s, setting, k, cut, flr, up, need, down)",
        "seq": _latch_steps()["seq"],
        "latch": f"""
          SELECT stay_id, s, k, CAST(0 AS BIGINT) AS rn, false AS lit, CAST(NULL AS DOUBLE) AS since, 0 AS cnt
          FROM (SELECT DISTINCT stay_id FROM seq), rules
          UNION ALL
          SELECT stay_id, s, k, rn, lit <> fire, CASE WHEN mv AND NOT fire THEN s1 END, CASE WHEN mv AND NOT fire THEN c1 ELSE 0 END
          FROM (SELECT *, mv AND t - s1 >= CASE WHEN lit THEN down ELSE up END AND (lit OR c1 >= need) AS fire
                FROM (SELECT l.stay_id, l.s, l.k, q.rn, l.lit, q.t, r.up, r.down, r.need,
                        CASE WHEN l.lit THEN q.p < r.flr ELSE q.p > r.cut END AS mv,
                        coalesce(CASE WHEN q.gap > {gap} THEN NULL ELSE l.since END, q.t) AS s1,
                        CASE WHEN q.gap > {gap} THEN 0 ELSE l.cnt END + 1 AS c1
                      FROM latch l JOIN seq q ON q.stay_id = l.stay_id AND q.rn = l.rn + 1 JOIN rules r ON r.s = l.s AND r.k = l.k))""",
        "shown": "SELECT q.stay_id, q.charttime, q.y, l.s, any_value(r.setting) AS setting, sum(CASE WHEN l.lit THEN 1 ELSE 0 END)"
                 " AS shown, sum(CASE WHEN q.p > r.cut THEN 1 ELSE 0 END) AS inst FROM latch l JOIN seq q USING (stay_id, rn)"
                 " JOIN rules r ON r.s = l.s AND r.k = l.k GROUP BY ALL",
        "lagged": "SELECT *, lag(shown) OVER (PARTITION BY s, stay_id ORDER BY charttime) AS before FROM shown",
        "lost": "SELECT s, max(y) AS hit, date_diff('microsecond', min(charttime) FILTER (WHERE inst >= 2), coalesce("
                "min(charttime) FILTER (WHERE shown >= 2), max(charttime))) / 60000000.0 AS x FROM shown"
                " GROUP BY s, stay_id HAVING max(inst) >= 2",
        "days": _EVAL_STEPS["days"],
        "l": "SELECT s, quantile_cont(x, 0.5) AS a, quantile_cont(x, 0.9) AS b, quantile_cont(x, 0.5) FILTER (WHERE hit = 1) AS c"
             " FROM lost GROUP BY s"},
        "SELECT any_value(setting) AS setting, round(count(*) FILTER (WHERE before <> shown) / (SELECT d FROM days), 6) AS"
        " flips_per_day, round(count(*) FILTER (WHERE y = 1 AND shown >= 2) / count(*) FILTER (WHERE y = 1), 6) AS"
        " sensitivity_high, round(coalesce(any_value(a), 0), 4) AS lost_lead_median_min, round(coalesce(any_value(b), 0), 4) AS"
        " lost_lead_p90_min, round(coalesce(any_value(c), 0), 4) AS lost_lead_median_min_positive"
        " FROM lagged LEFT JOIN l USING (s) GROUP BY s")
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def _solved_sql() -> str:
    """Rates at every cut of the grid by windows over runs, then the search as a recursive query."""
    d = SWEPT
    low, high = C.BUDGET_GRID_SPAN
    grid = ", ".join(repr(low + i * (high - low) / (C.BUDGET_GRID_POINTS - 1)) for i in range(C.BUDGET_GRID_POINTS))
    steps = {
        "readings": READINGS, "days": _EVAL_STEPS["days"],
        "grid": "SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT unnest(quantile_cont(p,"
                f" [{grid}])) AS x FROM readings)",
        "seq": _latch_steps()["seq"],
        "coarse": "SELECT j, CAST(floor((SELECT max(i) FROM grid) * (1 - j / 24.0)) AS BIGINT) AS i FROM"
                  " (SELECT unnest(range(25)) AS j)",
    }
    below = "0.0"
    for k, budget in enumerate(BUDGETS):
        side = lambda name, test: (
            f"sum(CASE WHEN {test} AND NOT coalesce(lag_{name} AND gap <= {d.max_gap_min}, false) THEN 1 ELSE 0 END)"
            " OVER (PARTITION BY i, stay_id ORDER BY rn)")
        steps |= {
            f"f{k}": f"SELECT i, x, x - {d.demote_margin} * (x - {below}) AS flr FROM grid",
            f"a{k}": f"SELECT g.i, s.stay_id, s.rn, s.t, s.gap, s.p > g.x AS u, s.p < g.flr AS w FROM seq s, f{k} g",
            f"b{k}": f"SELECT *, lag(u) OVER o AS lag_u, lag(w) OVER o AS lag_w FROM a{k} WINDOW o AS (PARTITION BY i, stay_id"
                     " ORDER BY rn)",
            f"c{k}": f"SELECT *, {side('u', 'u')} AS ru, {side('w', 'w')} AS rw FROM b{k} WHERE u OR w OR lag_u OR lag_w",
            f"d{k}": f"SELECT i, stay_id, rn, CASE WHEN u AND t - min(t) FILTER (WHERE u) OVER (PARTITION BY i, stay_id, ru) >="
                     f" {d.promote_min} AND rn - min(rn) FILTER (WHERE u) OVER (PARTITION BY i, stay_id, ru) + 1 >="
                     f" {d.promote_readings} THEN 1 WHEN w AND t - min(t) FILTER (WHERE w) OVER (PARTITION BY i, stay_id, rw) >="
                     f" {d.demote_min} THEN 0 END AS tr FROM c{k}",
            f"e{k}": "SELECT i, count(*) FILTER (WHERE tr = 1 AND coalesce(before, 0) = 0) / (SELECT d FROM days) AS rate FROM"
                     f" (SELECT i, tr, lag(tr) OVER (PARTITION BY i, stay_id ORDER BY rn) AS before FROM d{k} WHERE tr IS NOT NULL)"
                     " GROUP BY i",
            f"r{k}": f"SELECT g.i, g.x, coalesce(e.rate, 0) AS rate FROM grid g LEFT JOIN e{k} e USING (i)",
            f"s{k}": f"SELECT min(j) AS j FROM coarse JOIN r{k} USING (i) WHERE rate > {budget}",
            f"h{k}": f"SELECT (SELECT i FROM coarse WHERE j = (SELECT j FROM s{k})) AS bad, (SELECT i FROM coarse WHERE j ="
                     f" (SELECT j FROM s{k}) - 1) AS good UNION ALL SELECT CASE WHEN r.rate <= {budget} THEN bad ELSE r.i END,"
                     f" CASE WHEN r.rate <= {budget} THEN r.i ELSE good END FROM h{k} JOIN r{k} r ON r.i = (bad + good) // 2"
                     " WHERE good - bad > 1",
            f"z{k}": f"SELECT * FROM h{k} WHERE good - bad <= 1",
        }
        below = f"(SELECT x FROM r{k} WHERE i = (SELECT good FROM z{k}))"
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS band, CAST({b} AS DOUBLE) AS budget, round(a.x, 6) AS cut, round(a.rate, 6) AS promotions_per_day,"
        f" round(b.x, 6) AS cut_just_below, round(b.rate, 6) AS rate_just_below FROM z{k} JOIN r{k} a ON a.i = good"
        f" JOIN r{k} b ON b.i = bad" for k, (n, b) in enumerate(zip(C.BAND_NAMES[1:], BUDGETS)))
    return with_sources(["ev"], steps, rows).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "rank_metrics": _s({}, _rank_sql("")),
    "rank_metrics_by_group": with_sources(
        [], {"scored": f"SELECT *, subject_id % 5 AS grp FROM ({SCORED})"},
        f"SELECT grp, rows, ap, auc, brier FROM ({_rank_sql('grp')})"),
    "reliability_bins": _s({}, "SELECT bin, n, round(mean_predicted, 6) AS mean_predicted,"
                           f" round(observed, 6) AS observed FROM ({BINS})"),
    "level_metrics": _s({"bins": BINS, "base": "SELECT avg(y) AS b, count(*) AS t,"
                         " avg((p - y) ** 2) AS br FROM scored"},
        "SELECT round(sum(n / t * abs(mean_predicted - observed)), 6) AS ece,"
        " round(max(abs(mean_predicted - observed)), 6) AS mce,"
        " round(sum(n / t * (mean_predicted - observed) ** 2), 6) AS reliability,"
        " round(sum(n / t * (observed - b) ** 2), 6) AS resolution,"
        " round(any_value(b * (1 - b)), 6) AS uncertainty,"
        " round(any_value(1 - br / (b * (1 - b))), 6) AS brier_skill FROM bins, base"),
    "operating_points": _s(OP_STEPS, f"{_OP} FROM ({_op('SELECT CAST(unnest(range(1, 9)) AS DOUBLE) / 10 AS t')})"),
    "threshold_for_budget": _s(BUDGET_STEPS, _BUDGET),
    "kappa_jaccard": _s({}, _kappa("(y = 1)", "(p > 0.5)", "scored")),
    "kappa_labels": _kappa("(quality = 1)", "(toxic = 1)", "labels"),
    "label_coverage": _s({"h": "SELECT stay_id, count(DISTINCT date_trunc('hour', charttime)) AS hours,"
                          " count(*) AS n, sum(y) AS pos FROM scored GROUP BY stay_id"},
        "SELECT count(*) AS stays, count(*) FILTER (WHERE pos > 0) AS stays_with_positive,"
        " CAST(sum(n) AS BIGINT) AS rows, CAST(sum(pos) AS BIGINT) AS positives,"
        " round(sum(hours) / 24.0, 4) AS monitored_days,"
        " round(sum(pos) / (sum(hours) / 24.0), 4) AS positives_per_day FROM h"),
    "score_quantiles": _s({}, " UNION ALL ".join(
        f"SELECT y, {f}::DOUBLE AS fraction, round(quantile_cont(q, {f}), 6) AS quantile FROM scored"
        " GROUP BY y" for f in (0.05, 0.25, 0.5, 0.75, 0.95))),
    "ap_bootstrap": _s({"weights": _weights(REPLICATES, "subject_id", "scored")},
                       f"SELECT rep, round(ap, 6) AS ap FROM ({_ap_reps('p')})"),
    "metric_bootstrap": _s(
        {"weights": _weights(REPLICATES, "subject_id", "scored"), **_metric_reps("p")},
        "SELECT rep, round(ap, 6) AS ap, round(auc, 6) AS auc, round(brier, 6) AS brier, round(ece, 6) AS ece FROM m_p"),
    "metric_intervals": _s(
        {"weights": _weights(REPLICATES, "subject_id", "scored"), **_metric_reps("q")},
        f"SELECT metric, {_CI.format(v='v')} FROM l_q GROUP BY metric"),
    "metric_differences": _s(
        {"weights": _weights(REPLICATES, "subject_id", "scored"), **_metric_reps("p"), **_metric_reps("q"),
         "d": "SELECT metric, CASE WHEN metric IN ('ap', 'auc') THEN a.v - b.v ELSE b.v - a.v END AS x"
              " FROM l_p a JOIN l_q b USING (rep, metric)"},
        f"SELECT metric, {_CI.format(v='x')}, round(avg(CASE WHEN x <= 0 THEN 1 ELSE 0 END), 6) AS p_worse"
        " FROM d GROUP BY metric"),
    "ap_difference": _s(
        {"weights": _weights(REPLICATES, "subject_id", "scored"), "a": _ap_reps("p"),
         "b": _ap_reps("q"), "d": "SELECT a.ap - b.ap AS x FROM a JOIN b USING (rep)"},
        f"SELECT {_CI.format(v='x')}, round(avg(CASE WHEN x <= 0 THEN 1 ELSE 0 END), 6) AS p_worse"
        " FROM d"),
    "brier_difference": _s(
        {"weights": _weights(200, "subject_id", "scored"),
         "d": "SELECT rep, sum(wt * ((q - y) ** 2 - (p - y) ** 2)) / sum(wt) AS x FROM scored"
              " JOIN weights USING (subject_id) GROUP BY rep"},
        f"SELECT {_CI.format(v='x')}, round(avg(CASE WHEN x <= 0 THEN 1 ELSE 0 END), 6) AS p_worse"
        " FROM d"),
    "balanced_sample": with_sources([], {
        "base": "SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey, l_suppkey,"
                " CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem",
        "ranked": "SELECT *, rank() OVER (PARTITION BY y ORDER BY u DESC) AS above,"
                  " count(*) OVER (PARTITION BY y) AS size FROM (SELECT *, substr(md5('42|' ||"
                  " row_id || '|' || l_partkey || '|' || l_suppkey), 1, 12) AS u FROM base)",
        "sized": "SELECT *, count(*) OVER (PARTITION BY y ORDER BY u) AS upto,"
                 " (SELECT min(size) FROM ranked) AS take FROM ranked"},
        "SELECT y, count(*) AS rows, CAST(sum(row_id) AS BIGINT) AS ids FROM sized"
        " WHERE upto <= take GROUP BY y"),
    "stratified_sample": with_sources(["ev"], {
        "readings": READINGS,
        "b": "SELECT stay_id, epoch_us(charttime) // 60000000 AS charttime, CASE WHEN p > 0.8 THEN 3"
             " WHEN p > 0.55 THEN 2 WHEN p > 0.35 THEN 1 ELSE 0 END AS band FROM readings",
        "d": "SELECT *, md5('42|' || stay_id || '|' || charttime) AS h FROM b",
        "one": "SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY band, stay_id ORDER BY h,"
               " stay_id, charttime) = 1"},
        "SELECT stay_id, charttime, band FROM one QUALIFY row_number() OVER (PARTITION BY band"
        " ORDER BY h, stay_id, charttime) <= 10"),
    "instant_bands": _s({}, "SELECT CASE WHEN p > 0.8 THEN 'CRITICAL' WHEN p > 0.55 THEN 'HIGH' WHEN"
                        " p > 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS rows,"
                        " CAST(sum(y) AS BIGINT) AS positives FROM scored GROUP BY ALL"),
    "band_views": _b(
        {"lagged": _EVAL_STEPS["lagged"],
         "runs": "SELECT *, sum(CASE WHEN before IS DISTINCT FROM shown THEN 1 ELSE 0 END) OVER"
                 " (PARTITION BY stay_id ORDER BY charttime) AS run FROM lagged"},
        f"SELECT stay_id, epoch_us(charttime) // 60000000 AS charttime, {_NAME.format('inst')} AS"
        f" instant, {_NAME.format('shown')} AS displayed, CASE WHEN inst = shown THEN 'confirmed'"
        " WHEN inst > shown THEN 'provisional' ELSE 'demoting' END AS band_state,"
        " row_number() OVER (PARTITION BY stay_id, run ORDER BY charttime) AS readings_in_state"
        " FROM runs"),
    "band_evaluation": _b(_EVAL_STEPS, _EVAL.format(6)),
    "band_table": _b({}, f"SELECT {_NAME.format('shown')} AS band, count(*) AS rows,"
                     " round(count(*) / (SELECT count(*) FROM banded), 6) AS share,"
                     " round(avg(y), 6) AS observed_rate FROM banded GROUP BY shown"),
    "band_ratchet": _b(
        {"stays": "SELECT stay_id, date_diff('microsecond', min(charttime), max(charttime)) AS d,"
                  " count(*) AS n, count(*) FILTER (WHERE shown = 3) AS s,"
                  " count(*) FILTER (WHERE inst = 3) AS i FROM banded GROUP BY stay_id",
         "q": "SELECT *, len(list_filter((SELECT quantile_cont(d, [0.25, 0.5, 0.75]) FROM stays),"
              " lambda e: e <= d)) AS quartile FROM stays"},
        "SELECT quartile, count(*) AS stays, CAST(sum(n) AS BIGINT) AS rows, round(sum(s) / sum(n), 6)"
        " AS displayed, round(sum(i) / sum(n), 6) AS instant, round(sum(s) / sum(i), 6) AS ratio"
        " FROM q GROUP BY quartile"),
    "band_envelope": _b(
        {"weights": _weights(400, "stay_id", "readings"),
         "d": "SELECT rep, shown, sum(wt * y) / sum(wt) AS x FROM banded JOIN weights USING (stay_id)"
              " WHERE wt > 0 GROUP BY ALL"},
        "SELECT shown AS displayed_index, round(avg(x), 6) AS mean,"
        " round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi,"
        " count(*) AS resamples,"
        " round(greatest(quantile_cont(x, 0.025) - 0.02, 0), 6) AS envelope_lo,"
        " round(least(quantile_cont(x, 0.975) + 0.02, 1), 6) AS envelope_hi FROM d GROUP BY shown"),
    "patient_days": with_sources(["ev"], {"readings": READINGS, "days": _EVAL_STEPS["days"]},
                                 "SELECT round(d, 6) AS days FROM days"),
    "charting_gaps": with_sources(["ev"], {
        "readings": READINGS,
        "g": "SELECT (epoch_us(charttime) - lag(epoch_us(charttime)) OVER (PARTITION BY stay_id ORDER"
             " BY charttime)) / 60000000.0 AS x FROM readings"},
        "SELECT round(quantile_cont(x, 0.25), 4) AS p25_min, round(quantile_cont(x, 0.5), 4) AS"
        " median_min, round(quantile_cont(x, 0.75), 4) AS p75_min FROM g"),
    "promotion_profile": _profile_sql(),
    "band_sweep": _sweep_sql(),
    "solved_cuts": _solved_sql(),
}
