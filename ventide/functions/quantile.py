"""Exact order statistics of large groups, without gathering a group in one task.

Values are counted first, so ties cost nothing. The distinct values are then cut into
slices at approximate percentiles; slices are ordered independently and a slice's offset
comes from the slice totals. The number of slices follows the counted values, from SLICES up to
MOST_SLICES per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide.session import materialize

SLICES, MOST_SLICES, SLICE_ROWS = 256, 10_000, 1_000_000


def slices_for(rows: int) -> int:
    """As many slices as keep each at about SLICE_ROWS distinct values."""
    return min(MOST_SLICES, max(SLICES, rows // SLICE_ROWS))


def slice_of(edges: Column, value: Column, size: int = SLICES) -> Column:
    """How many of the sorted edges lie below the value, by bisection."""
    steps = (size + 1).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        open_ = span["lo"] < span["hi"]
        below = F.get(edges, middle) < value
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(span["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(span["hi"]).alias("hi"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda span: span["lo"]
    )


def cumulate(
    counted: DataFrame,
    groups: Sequence[str],
    value: str,
    sums: Mapping[str, str],
    descending: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Running totals in order of `value` inside each group, the row included.

    counted: one row per (groups, value, tie), written once because edges, offsets and slices
    all read it. sums: output name -> column to add up.
    """
    groups = list(groups)
    counted = materialize(counted)
    slices = slices_for(counted.count())
    grid = [i / slices for i in range(1, slices)]
    edge = F.percentile_approx(F.col(value), [float(g) for g in grid], 10_000).alias("_edges")
    base = counted.withColumn("_one", F.lit(1)) if not groups else counted
    by = groups or ["_one"]
    if groups:
        edged = base.join(base.groupBy(*by).agg(edge), by)
    else:
        # One array for everything: a scalar, not a join on a constant.
        edged = base.withColumn("_edges", base.agg(edge).scalar())
    sliced = edged.withColumn("_slice", slice_of(F.col("_edges"), F.col(value), slices))
    sliced = sliced.drop("_edges")
    position = F.col("_slice").desc() if descending else F.col("_slice").asc()
    before = (
        Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sliced.groupBy(*by, "_slice")
        .agg(*[F.sum(column).alias(name) for name, column in sums.items()])
        .select(
            *by, "_slice",
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        )
    )
    inside = (
        Window.partitionBy(*by, "_slice")
        .orderBy(F.col(value).desc() if descending else F.col(value).asc(), *tie)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = sliced.join(offsets, [*by, "_slice"])
    return running.select(
        *counted.columns,
        *[
            (F.sum(column).over(inside) + F.col(f"_o_{name}")).alias(name)
            for name, column in sums.items()
        ],
    )


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, fractions: Sequence[float]
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per (groups, fraction)."""
    groups = list(groups)
    counted = materialize(
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
            F.count(F.lit(1)).alias("_n"))
    )
    running = cumulate(counted, groups, value, {"_upto": "_n"})
    by = groups or [F.lit(1).alias("_one")]
    totals = counted.groupBy(*by).agg(F.sum("_n").alias("_total"))
    wanted = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")
    rank = F.col("fraction") * (F.col("_total") - 1)
    marks = totals.select(*groups, wanted, "_total").select(
        *groups, "fraction", F.floor(rank).alias("_lo"), F.ceil(rank).alias("_hi"),
        (rank - F.floor(rank)).alias("_part"),
    )
    # Every fraction of a group as one array: a value row keeps only the marks it covers.
    listed = F.collect_list(F.struct("fraction", "_lo", "_hi", "_part")).alias("_marks")
    if groups:
        joined = running.join(marks.groupBy(*groups).agg(listed), groups)
    else:
        joined = running.withColumn("_marks", marks.agg(listed).scalar())
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def covers(mark: Column, side: str) -> Column:
        return (mark[side] >= first) & (mark[side] <= last)

    kept = joined.select(
        *groups,
        value,
        F.explode(
            F.filter(F.col("_marks"), lambda m: covers(m, "_lo") | covers(m, "_hi"))
        ).alias("_m"),
        first.alias("_first"),
        last.alias("_last"),
    )
    at = lambda side: F.max(
        F.when(F.col(f"_m.{side}").between(F.col("_first"), F.col("_last")), F.col(value))
    )
    found = kept.groupBy(*groups, F.col("_m.fraction").alias("fraction")).agg(
        at("_lo").alias("_vlo"), at("_hi").alias("_vhi"), F.max("_m._part").alias("_part")
    )
    return found.select(
        *groups,
        "fraction",
        (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_part")).alias("quantile"),
    )
