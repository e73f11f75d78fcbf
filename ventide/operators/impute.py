"""Carry-forward companions with a freshness limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.quantile import quantiles
from ventide.functions.timefn import elapsed_minutes
from ventide.operators.scan import DAY_SECONDS, Running, scan
from ventide.session import materialize


def reference_medians(wide: DataFrame, split: DataFrame) -> dict[str, float | None]:
    """Median per parameter over training patients only: one number per parameter."""
    split = materialize(split)
    train = wide.join(split.where(F.col("split") == "train").select("subject_id"), "subject_id")
    long = train.select(*C.PARAMS).unpivot([], list(C.PARAMS), "parameter", "v")
    found = {
        row["parameter"]: row["quantile"]
        for row in quantiles(long, ["parameter"], "v", [0.5]).collect()
    }
    return {p: found.get(p) for p in C.PARAMS}


def locf_companions(
    wide: DataFrame,
    reference: dict[str, float | None],
    causal: bool = False,
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """Five columns per parameter: observed, age of the value in use, carried value while
    fresh, never measured in the stay, and the value with the training median as fallback.

    causal=True asks "never measured so far" instead, which a live system can know.
    """
    specs = {}
    for p in C.PARAMS:
        seen = F.when(
            F.col(p).isNotNull(), F.struct(F.col(p).alias("v"), F.col("charttime").alias("t"))
        )
        count = F.col(p).isNotNull().cast("long")
        specs[f"_in_use_{p}"] = Running("last", seen)
        specs[f"_seen_{p}"] = Running("sum" if causal else "all_sum", count)
    scanned = scan(wide, ["stay_id"], "charttime", specs, width_s=width_s)
    columns = []
    for p in C.PARAMS:
        age = elapsed_minutes(F.col(f"_in_use_{p}.t"), F.col("charttime"))
        locf = F.when(age <= C.LOCF_CUTOFF_MIN, F.col(f"_in_use_{p}.v"))
        columns += [
            F.col(p),
            F.col(p).isNotNull().cast("byte").alias(f"{p}_observed"),
            age.alias(f"{p}_delta_t_min"),
            locf.alias(f"{p}_locf"),
            (F.col(f"_seen_{p}") == 0).cast("byte").alias(f"{p}_structurally_missing_in_stay"),
            F.coalesce(locf, F.lit(reference.get(p)).cast("double")).alias(f"{p}_final"),
        ]
    return scanned.select("stay_id", "subject_id", "charttime", *columns, "warning")


def elapsed_in_stay(readings: DataFrame, width_s: int = DAY_SECONDS) -> DataFrame:
    """Minutes since the first reading of the stay."""
    scanned = scan(
        readings, ["stay_id"], "charttime",
        {"_begin": Running("all_min", F.col("charttime"))}, width_s=width_s,
    )
    return scanned.withColumn(
        "minutes_in_stay", elapsed_minutes(F.col("_begin"), F.col("charttime"))
    ).drop("_begin")


def sliding_windows(readings: DataFrame, value: str, length: int = 100, stride: int = 20,
                    width_s: int = DAY_SECONDS) -> DataFrame:
    """Full windows of `length` consecutive readings of a stay, one every `stride` readings.

    A reading is copied into the few windows it belongs to, and a window is one small group:
    no stay is gathered whole.
    """
    numbered = scan(
        readings.select("stay_id", "charttime", value), ["stay_id"], "charttime",
        {"_n": Running("sum", F.lit(1).cast("long"))}, width_s=width_s,
    ).withColumn("_i", F.col("_n") - 1)
    first = F.greatest(F.ceil((F.col("_i") - length + 1) / stride), F.lit(0))
    last = F.floor(F.col("_i") / stride)
    member = numbered.where(first <= last).withColumn("window", F.explode(F.sequence(first, last)))
    return (
        member.groupBy("stay_id", "window")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("charttime").alias("window_start"),
             F.array_sort(F.collect_list(F.struct("charttime", F.col(value).alias("v")))).alias("_v"))
        .where(F.col("_size") == length)
        .select("stay_id", "window", "window_start",
                F.transform("_v", lambda s: s["v"]).alias("values"))
    )
