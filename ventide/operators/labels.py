"""Forward-looking labels: what happens after a reading, and whether it could be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.timefn import boundary_diff, plus_hours
from ventide.operators.scan import DAY_SECONDS, Running, range_window, scan

VARIANTS = ("resp", "circ", "composite", "strict")
COMPONENTS = ("d_fio2", "d_peep", "d_spo2", "d_vaso", "s_fio2", "s_peep")


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def forward_labels(
    imputed: DataFrame,
    pressor: DataFrame,
    rules: C.LabelRules = C.LabelRules(),
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """Labels over (t + 1 s, t + H] with censoring, four variants per horizon.

    Baselines are the values in force at t, forward values are measured ones. A positive
    needs one component; a negative needs the whole window inside the stay; the rest is null.
    `pressor` holds (stay_id, charttime, vasopressor_running).
    """
    needed = ["stay_id", "charttime", "spo2", "fio2", "peep", "fio2_locf", "peep_locf",
              "fio2_delta_t_min", "peep_delta_t_min"]
    base = imputed.select(*needed).join(
        pressor.select("stay_id", "charttime", "vasopressor_running"),
        ["stay_id", "charttime"], "left",
    ).select(*needed, F.coalesce("vasopressor_running", F.lit(0)).cast("int").alias("vaso_now"))
    marked = scan(
        base,
        ["stay_id"],
        "charttime",
        {
            "_next_fio2": Running("last", F.col("fio2"), strict=True, reverse=True),
            "_on_before": Running(
                "last", F.when(F.col("vaso_now") == 1, F.col("charttime")), strict=True
            ),
            "_t_end": Running("all_max", F.col("charttime")),
        },
        width_s=width_s,
    )
    # The level both this and the next FiO2 reading reach; unknown without a next one.
    lasting = F.when(
        F.col("fio2").isNotNull() & F.col("_next_fio2").isNotNull(),
        F.least("fio2", "_next_fio2"),
    )
    off_long = boundary_diff("minute", F.col("_on_before"), F.col("charttime"))
    fresh_start = F.col("_on_before").isNull() | (off_long >= rules.pressor_off_min)
    marked = marked.withColumn("_fio2", lasting if rules.fio2_persist else F.col("fio2"))
    marked = marked.withColumn(
        "_vaso",
        ((F.col("vaso_now") == 1) & fresh_start).cast("int")
        if rules.pressor_strict
        else F.col("vaso_now"),
    )
    frames = {}
    for h in rules.horizons_h:
        frame = (1, h * 3600)
        frames[f"_spo2_{h}"] = (F.min("spo2"), *frame)
        frames[f"_fio2_{h}"] = (F.max("_fio2"), *frame)
        frames[f"_peep_{h}"] = (F.max("peep"), *frame)
        frames[f"_vaso_{h}"] = (F.max("_vaso"), *frame)
    ahead = range_window(marked, ["stay_id"], "charttime", frames, width_s=width_s)
    flags, labels = [], []
    for h in rules.horizons_h:
        fio2 = F.col(f"_fio2_{h}") - F.col("fio2_locf") >= rules.fio2_rise
        peep = F.col(f"_peep_{h}") - F.col("peep_locf") >= rules.peep_rise
        recent = rules.strict_baseline_age_min
        parts = {
            "d_fio2": _true(fio2),
            "d_peep": _true(peep),
            "d_spo2": _true(F.col(f"_spo2_{h}") < rules.spo2_below),
            "d_vaso": _true((F.col(f"_vaso_{h}") == 1) & (F.col("vaso_now") == 0)),
            "s_fio2": _true(fio2 & (F.col("fio2_delta_t_min") <= recent)),
            "s_peep": _true(peep & (F.col("peep_delta_t_min") <= recent)),
        }
        complete = plus_hours(F.col("charttime"), h) <= F.col("_t_end")
        fired = {
            "resp": parts["d_fio2"] | parts["d_peep"] | parts["d_spo2"],
            "circ": parts["d_vaso"],
            "composite": parts["d_fio2"] | parts["d_peep"] | parts["d_spo2"] | parts["d_vaso"],
            "strict": parts["s_fio2"] | parts["s_peep"] | parts["d_spo2"] | parts["d_vaso"],
        }
        for variant in VARIANTS:
            label = F.when(fired[variant], 1).when(complete, 0)
            labels.append(label.cast("byte").alias(f"y_{variant}_{h}h"))
        labels.append(complete.alias(f"complete_{h}h"))
        flags += [column.alias(f"{name}_{h}h") for name, column in parts.items()]
    return ahead.select("stay_id", "charttime", *labels, *flags)


def label_columns(labels: DataFrame) -> set[str]:
    """Everything in the label table but its keys; none of it may become a feature."""
    return set(labels.columns) - {"stay_id", "charttime"}


def prevalence(labels: DataFrame, rules: C.LabelRules = C.LabelRules()) -> DataFrame:
    """One row per variant and horizon from a single aggregation over the label table."""
    names = [f"y_{v}_{h}h" for v in VARIANTS for h in rules.horizons_h]
    long = labels.select("stay_id", *names).unpivot(["stay_id"], names, "label", "y")
    per_stay = long.groupBy("label", "stay_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("y").alias("labelled"),
        F.count_if(F.col("y") == 1).alias("positive"),
    )
    return per_stay.groupBy("label").agg(
        F.sum("rows").alias("rows"),
        F.sum("labelled").alias("rows_labelled"),
        F.sum("positive").alias("positive"),
        F.count_if(F.col("positive") > 0).alias("stays_with_positive"),
    ).withColumn("positive_rate", F.try_divide("positive", "rows_labelled"))


def vac_days(wide: DataFrame) -> DataFrame:
    """Day-anchored ventilator-associated condition, one row per stay.

    Windows run over one row per stay and day.
    """
    daily = (
        wide.where(F.col("peep").isNotNull() | F.col("fio2").isNotNull())
        .groupBy("stay_id", F.to_date("charttime").alias("day"))
        .agg(F.min("peep").alias("peep"), F.min("fio2").alias("fio2"))
    )
    order = Window.partitionBy("stay_id").orderBy("day")
    rises = []
    for name, rise in (("peep", C.VAC_PEEP_RISE), ("fio2", C.VAC_FIO2_RISE)):
        base = F.least(F.lag(name, 1).over(order), F.lag(name, 2).over(order))
        now = F.col(name) - base >= rise
        after = F.lead(name, 1).over(order) - base >= rise
        rises.append(_true(now & after))
    days = F.count(F.lit(1)).over(Window.partitionBy("stay_id"))
    return (
        daily.select("stay_id", "day", days.alias("n_days"), (rises[0] | rises[1]).alias("rise"))
        .groupBy("stay_id")
        .agg(
            F.max("n_days").alias("n_days"),
            F.max((F.col("rise") & (F.col("n_days") >= C.VAC_MIN_DAYS)).cast("int")).alias("vac"),
        )
    )


def hourly_forward(
    wide: DataFrame, pressor: DataFrame, horizon_h: int = C.HOURLY_HORIZON_H,
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """Hour bins with escalation, desaturation and composite flags over the next hours."""
    hourly = (
        wide.join(pressor.select("stay_id", "charttime", "vasopressor_running"),
                  ["stay_id", "charttime"], "left")
        .groupBy("stay_id", F.date_trunc("hour", "charttime").alias("hr"))
        .agg(
            F.min("fio2").alias("fio2_now"), F.max("fio2").alias("_fio2_max"),
            F.min("peep").alias("peep_now"), F.max("peep").alias("_peep_max"),
            F.min("spo2").alias("_spo2_min"),
            F.max(F.coalesce("vasopressor_running", F.lit(0)).cast("int")).alias("vaso_now"),
        )
    )
    frame = (1, horizon_h * 3600)
    ahead = range_window(
        hourly, ["stay_id"], "hr",
        {
            "fio2_ahead": (F.max("_fio2_max"), *frame),
            "peep_ahead": (F.max("_peep_max"), *frame),
            "spo2_ahead": (F.min("_spo2_min"), *frame),
            "vaso_ahead": (F.max("vaso_now"), *frame),
        },
        width_s=width_s,
    )
    escalation = _true(F.col("fio2_ahead") - F.col("fio2_now") >= C.VAC_FIO2_RISE) | _true(
        F.col("peep_ahead") - F.col("peep_now") >= C.VAC_PEEP_RISE
    )
    desaturation = _true(F.col("spo2_ahead") < C.DESATURATION_BELOW)
    pressor_start = _true((F.col("vaso_ahead") == 1) & (F.col("vaso_now") == 0))
    return ahead.select(
        "stay_id", "hr",
        escalation.alias("escalation"),
        desaturation.alias("desaturation"),
        (escalation | desaturation | pressor_start).alias("composite"),
    )
