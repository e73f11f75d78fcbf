"""Agreement of two tables, and set relations of their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def close(a: Column, b: Column, relative: float = 0.01, absolute: float = 0.01) -> Column:
    return F.abs(a - b) <= relative * F.abs(b) + absolute


def agreement(ours: DataFrame, theirs: DataFrame, keys: Sequence[str],
              columns: Sequence[str]) -> DataFrame:
    """Per column over matched keys: rows with both values and the share that agree."""
    keys = list(keys)
    right = theirs.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = ours.select(*keys, *columns).join(right, keys)
    counted = joined.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNotNull() & F.col(f"_b_{c}").isNotNull()).alias(f"{c}:both")
          for c in columns],
        *[F.count_if(close(F.col(c), F.col(f"_b_{c}"))).alias(f"{c}:ok") for c in columns],
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col("_rows").alias("matched"),
                        F.col(f"`{c}:both`").alias("both"),
                        F.try_divide(100.0 * F.col(f"`{c}:ok`"), F.col(f"`{c}:both`"))
                        .alias("pct_within"),
                    )
                    for c in columns
                ]
            )
        )
    )


def parse_export_time(text: Column) -> Column:
    """Timestamps such as 3/7/2150 4:05 in the reference exports."""
    return F.to_timestamp(text, "M/d/yyyy H:mm")


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on the left, on the right and on both sides, as one row."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    both = a.intersect(b)
    return (
        a.agg(F.count(F.lit(1)).alias("left_keys"))
        .select(
            "left_keys",
            b.agg(F.count(F.lit(1))).scalar().alias("right_keys"),
            both.agg(F.count(F.lit(1))).scalar().alias("shared_keys"),
        )
    )


def missing_values(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted values that never occur."""
    return wanted.select(key).join(present.select(key), key, "left_anti")
