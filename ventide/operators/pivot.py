"""Long event log to one row per (stay, chart time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators.clean import drop_all_null, plausible_value


def _plausible() -> Column:
    """The value of an event by the rules of its item's parameter."""
    rules = [(item, plausible_value(param, item, F.col("valuenum")))
             for param, items in C.PARAM_ITEMS.items() for item in items]
    out = F.when(F.col("itemid") == rules[0][0], rules[0][1])
    for item, value in rules[1:]:
        out = out.when(F.col("itemid") == item, value)
    return out


def events_in_window(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Parameter events charted inside their stay's ventilation window (inclusive).

    The cohort has one row per stay. Spark broadcasts it when its size allows and splits
    hot stays of a sort-merge join at run time otherwise.
    """
    window = cohort.select("stay_id", "vent_start", "vent_end")
    return (
        events.where(F.col("itemid").isin(*C.SOURCE_ITEMS))
        .join(window, "stay_id")
        .where(F.col("charttime").between(F.col("vent_start"), F.col("vent_end")))
        .drop("vent_start", "vent_end")
    )


def events_to_wide(events: DataFrame, cohort: DataFrame) -> DataFrame:
    """Median per parameter and instant with range, unit and source-preference rules.

    Medians are taken in long form, one small buffer per (stay, instant, item), and then set side
    by side. Both groupings share one shuffle by (stay, instant), so a stay with many readings
    spreads over all tasks.
    """
    dealt = (
        events_in_window(events, cohort)
        .select("stay_id", "charttime", "itemid", "subject_id", "warning", _plausible().alias("_v"))
        .repartition("stay_id", "charttime")
    )
    medians = dealt.groupBy("stay_id", "charttime", "itemid").agg(
        F.median("_v").alias("_m"), F.min("subject_id").alias("subject_id"),
        F.max("warning").alias("warning"))
    of = lambda item: F.max(F.when(F.col("itemid") == item, F.col("_m")))
    wide = medians.groupBy("stay_id", "charttime").agg(
        F.min("subject_id").alias("subject_id"),
        *[F.coalesce(*map(of, items)).alias(param) for param, items in C.PARAM_ITEMS.items()],
        F.max("warning").cast("byte").alias("warning"),
    )
    return drop_all_null(wide, C.PARAMS).select(
        "stay_id", "subject_id", "charttime", *C.PARAMS, "warning"
    )


def fill_rates(wide: DataFrame) -> DataFrame:
    """Share of rows with a value, one row per parameter, from one aggregation."""
    counts = wide.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(p).alias(p) for p in C.PARAMS]
    )
    return (
        counts.unpivot("_rows", list(C.PARAMS), "parameter", "filled")
        .select(
            "parameter",
            F.col("filled").cast("long").alias("filled"),
            F.col("_rows").alias("rows"),
            F.try_divide(100.0 * F.col("filled"), F.col("_rows")).alias("pct_filled"),
        )
    )
