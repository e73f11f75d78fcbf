"""Unit and plausibility rules for charted values."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide import config as C


def normalised_value(item: int, value: Column) -> Column:
    """FiO2 is charted as a fraction or as a percentage; report percentages."""
    if item != C.ITEM_FIO2:
        return value
    fraction = (value > 0) & (value <= C.FIO2_FRACTION_MAX)
    return F.when(fraction, value * 100).otherwise(value)


def plausible_value(param: str, item: int, value: Column) -> Column:
    """The value in the parameter's unit, null where out of range."""
    v = normalised_value(item, value)
    lo, hi = C.PLAUSIBLE[param]
    return F.when(v.between(lo, hi), v)


def keep_items(events: DataFrame, items: Iterable[int] = C.CACHED_ITEMS) -> DataFrame:
    """The narrow event log: wanted items with a value or a text, ids as integers."""
    return events.where(F.col("itemid").isin(*items) & F.col("stay_id").isNotNull()).select(
        F.col("stay_id").cast("int").alias("stay_id"),
        F.col("subject_id").cast("int").alias("subject_id"),
        F.col("hadm_id").cast("int").alias("hadm_id"),
        "charttime",
        F.col("itemid").cast("int").alias("itemid"),
        "valuenum",
        "value",
        F.coalesce(F.col("warning"), F.lit(0)).cast("byte").alias("warning"),
    )


def drop_all_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def item_report(events: DataFrame) -> DataFrame:
    """Per parameter item: values charted, values out of range, and the unit mix."""
    value = F.col("valuenum")
    rows = [
        (param, item, float(lo), float(hi))
        for param, items in C.PARAM_ITEMS.items()
        for item in items
        for lo, hi in [C.PLAUSIBLE[param]]
    ]
    rules = events.sparkSession.createDataFrame(
        rows, "parameter string, itemid int, lo double, hi double"
    )
    v = (
        F.when(
            (F.col("itemid") == C.ITEM_FIO2) & (value > 0) & (value <= C.FIO2_FRACTION_MAX),
            value * 100,
        )
        .otherwise(value)
    )
    # 12 rule rows.
    return (
        events.where(value.isNotNull())
        .join(F.broadcast(rules), "itemid")
        .groupBy("parameter", "itemid")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~v.between(F.col("lo"), F.col("hi"))).alias("out_of_range"),
            F.count_if((value > 0) & (value <= C.FIO2_FRACTION_MAX)).alias("fraction_scale"),
            F.count_if(value <= 0).alias("non_positive"),
        )
    )


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
