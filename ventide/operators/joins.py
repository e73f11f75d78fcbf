"""As-of and interval joins built from running values, without pairing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide.functions.timefn import boundary_diff
from ventide.operators.scan import DAY_SECONDS, Running, scan
from ventide.session import materialize

_END, _READING, _START = 0, 1, 2


def asof_before(
    readings: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    event_time: str,
    values: Sequence[str],
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """Left join each reading to the last event strictly before it.

    `readings` and `events` are merged into one ordered stream in which an event sorts
    after a reading of the same instant; `values` and `event_time` come out null where
    there is no earlier event. Events must be unique per (keys, event_time).
    """
    keys = list(keys)
    payload = F.struct(F.col(event_time).alias("_at"), *[F.col(v) for v in values])
    left = readings.withColumn("_rank", F.lit(_READING))
    right = events.select(
        *keys, F.col(event_time).alias(time), payload.alias("_event"), F.lit(_START).alias("_rank")
    )
    merged = left.unionByName(right, allowMissingColumns=True)
    found = scan(
        merged,
        keys,
        time,
        {"_hit": Running("last", F.col("_event"))},
        tie=["_rank"],
        width_s=width_s,
    ).where(F.col("_rank") == _READING)
    return found.select(
        *readings.columns,
        F.col("_hit._at").alias(event_time),
        *[F.col(f"_hit.{v}").alias(v) for v in values],
    )


def interval_state(
    readings: DataFrame,
    intervals: DataFrame,
    key: str,
    time: str,
    group: str,
    groups: Sequence[str],
    start: str,
    end: str,
    rate: str,
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """State of every interval group at every reading, from intervals with start < t < end.

    Adds per group: `<g>_running` (0/1), `<g>_rate` (sum of rates) and
    `<g>_minutes_since_start` (oldest active interval, -1 if none). A null end counts as
    the start, so an open-ended interval is never active.

    A join of readings with overlapping intervals grows with their product. Instead:
    count and rate are running sums of +start and -end entries (rates are decimals, so
    the sums are exact in any order), and the oldest active interval is the next one to end
    among the intervals that, by start, push the largest end seen so far.
    """
    spans = intervals.select(
        key,
        F.col(group).alias("_group"),
        F.col(start).alias("_start"),
        F.coalesce(F.col(end), F.col(start)).alias("_end"),
        F.coalesce(F.col(rate), F.lit(0)).cast("decimal(20,6)").alias("_rate"),
    ).where(F.col("_end") > F.col("_start"))
    spans = spans.groupBy(key, "_group", "_start", "_end").agg(
        F.sum("_rate").alias("_rate"), F.count(F.lit(1)).alias("_n")
    )
    spans = scan(
        spans,
        [key, "_group"],
        "_start",
        {"_seen": Running("max", F.col("_end"), strict=True)},
        tie=["_end"],
        width_s=width_s,
    )
    pushes = F.col("_seen").isNull() | (F.col("_end") > F.col("_seen"))
    edges = spans.select(
        key,
        "_group",
        F.explode(
            F.array(
                F.struct(
                    F.col("_start").alias("at"),
                    F.lit(_START).alias("rank"),
                    F.col("_n").alias("n"),
                    F.col("_rate").cast("decimal(30,6)").alias("rate"),
                    F.lit(None).cast("timestamp").alias("since"),
                ),
                F.struct(
                    F.col("_end").alias("at"),
                    F.lit(_END).alias("rank"),
                    (-F.col("_n")).alias("n"),
                    (-F.col("_rate")).cast("decimal(30,6)").alias("rate"),
                    F.when(pushes, F.col("_start")).alias("since"),
                ),
            )
        ).alias("_e"),
    )
    # One entry per instant, side and group: ties collapse before the scan reads them twice.
    edges = materialize(
        edges.groupBy(key, F.col("_e.at").alias(time), F.col("_e.rank").alias("_rank"), "_group")
        .agg(
            F.sum("_e.n").alias("_n"),
            F.sum("_e.rate").cast("decimal(30,6)").alias("_rate"),
            F.min("_e.since").alias("_since"),
        )
    )
    merged = readings.withColumn("_rank", F.lit(_READING)).unionByName(
        edges.withColumn("_tie", F.col("_group")), allowMissingColumns=True
    )
    specs = {}
    for g in groups:
        mine = F.col("_group") == g
        specs[f"_n_{g}"] = Running("sum", F.when(mine, F.col("_n")))
        specs[f"_r_{g}"] = Running("sum", F.when(mine, F.col("_rate")))
        specs[f"_s_{g}"] = Running("last", F.when(mine, F.col("_since")), strict=True, reverse=True)
    found = scan(merged, [key], time, specs, tie=["_rank", "_tie"], width_s=width_s)
    found = found.where(F.col("_rank") == _READING)
    columns = []
    for g in groups:
        running = F.coalesce(F.col(f"_n_{g}"), F.lit(0)) > 0
        columns += [
            running.cast("byte").alias(f"{g}_running"),
            F.coalesce(F.col(f"_r_{g}"), F.lit(0)).cast("double").alias(f"{g}_rate"),
            F.when(running, boundary_diff("minute", F.col(f"_s_{g}"), F.col(time)))
            .otherwise(F.lit(-1))
            .cast("double")
            .alias(f"{g}_minutes_since_start"),
        ]
    return found.select(*readings.columns, *columns)
