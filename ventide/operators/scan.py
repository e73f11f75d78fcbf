"""Ordered computations over entities whose history may be very long.

A window partitioned by the entity alone puts a whole entity into one task. When one
entity holds a third of all readings that task never ends. Everything here therefore
partitions by (entity, time chunk):

* `scan` computes running values inside each chunk, one summary row per chunk, and adds
  what the earlier (or later) chunks contribute. Only summaries are ever ordered by the
  entity alone: one row per chunk, i.e. time span / chunk width, whatever the row count.
* `range_window` answers windows of bounded length by copying the few rows that a
  neighbouring chunk has to see. One shuffle, no join.

Readings are unique per (entity, instant), so a chunk holds at most width / resolution
rows: 1,440 for a day of minutes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide.functions.timefn import micros, time_chunk

DAY_SECONDS = 86_400


@dataclass(frozen=True)
class Running:
    """One running value.

    kind: last (non-null), sum, max, min over the rows up to the current one, or
    all_sum, all_max, all_min over the whole entity.
    strict leaves the current row out; reverse looks at the rows after instead of before.
    """

    kind: str
    value: Column
    strict: bool = False
    reverse: bool = False

    @property
    def whole(self) -> bool:
        return self.kind.startswith("all_")


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    specs: Mapping[str, Running],
    tie: Sequence[str] = (),
    width_s: int = DAY_SECONDS,
    chunk: Column | None = None,
) -> DataFrame:
    """Add one column per spec. `df` is read twice, so it should be cheap to read again
    (a file or a materialized stage).

    `chunk` replaces the time chunk where `time` is not a clock; it must rise with `time`.
    """
    keys = list(keys)
    order = [time, *tie]
    base = df
    for name, spec in specs.items():
        base = base.withColumn(f"_v_{name}", spec.value)
    base = base.withColumn("_chunk", time_chunk(F.col(time), width_s) if chunk is None else chunk)

    position = F.struct(*[F.col(c) for c in order])
    totals = []
    for name, spec in specs.items():
        value = F.col(f"_v_{name}")
        if spec.kind == "last":
            edge = F.min_by if spec.reverse else F.max_by
            total = edge(value, F.when(value.isNotNull(), position))
        else:
            total = _FOLD[spec.kind.removeprefix("all_")](value)
        totals.append(total.alias(f"_t_{name}"))
    summary = base.groupBy(*keys, "_chunk").agg(*totals)

    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, spec in specs.items():
        total = F.col(f"_t_{name}")
        side = later if spec.reverse else earlier
        if spec.whole:
            column = _FOLD[spec.kind.removeprefix("all_")](total).over(whole)
        elif spec.kind == "last":
            column = F.last(total, ignorenulls=True).over(side)
        else:
            column = _FOLD[spec.kind](total).over(side)
        carried.append(column.alias(f"_c_{name}"))
    carry = summary.select(*keys, "_chunk", *carried)

    local = Window.partitionBy(*keys, "_chunk")
    upward = local.orderBy(*[F.col(c).asc() for c in order])
    downward = local.orderBy(*[F.col(c).desc() for c in order])
    inside = []
    for name, spec in specs.items():
        if spec.whole:
            continue
        frame = (downward if spec.reverse else upward).rowsBetween(
            Window.unboundedPreceding, -1 if spec.strict else 0
        )
        value = F.col(f"_v_{name}")
        column = (
            F.last(value, ignorenulls=True).over(frame)
            if spec.kind == "last"
            else _FOLD[spec.kind](value).over(frame)
        )
        inside.append(column.alias(f"_l_{name}"))

    joined = base.select(*df.columns, "_chunk", *inside).join(carry, [*keys, "_chunk"], "left")
    out = []
    for name, spec in specs.items():
        c = F.col(f"_c_{name}")
        if spec.whole:
            out.append(c.alias(name))
            continue
        here = F.col(f"_l_{name}")
        if spec.kind == "last":
            out.append(F.coalesce(here, c).alias(name))
        elif spec.kind == "sum":
            both = F.coalesce(here, F.lit(0)) + F.coalesce(c, F.lit(0))
            out.append(F.when(here.isNotNull() | c.isNotNull(), both).alias(name))
        elif spec.kind == "max":
            out.append(F.greatest(here, c).alias(name))
        else:
            out.append(F.least(here, c).alias(name))
    return joined.select(*df.columns, *out)


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    before_s: int = 0,
    after_s: int = 0,
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """Assign chunks and copy rows to the neighbouring chunk that can see them.

    Adds `_chunk` and `_own` (false on copies). `before_s` is how far back a row looks,
    `after_s` how far ahead; neither may exceed the chunk width.
    """
    if before_s > width_s or after_s > width_s:
        raise ValueError("a chunk must be at least as wide as the window")
    width = width_s * 1_000_000
    own = time_chunk(F.col(time), width_s)
    offset = micros(F.col(time)) - own * F.lit(width)
    spot = F.struct(own.alias("chunk"), F.lit(True).alias("own"))
    nothing = F.lit(None).cast("struct<chunk:bigint,own:boolean>")
    spots = [spot]
    if after_s:
        ahead = F.struct((own - 1).alias("chunk"), F.lit(False).alias("own"))
        spots.append(F.when(offset <= F.lit(after_s * 1_000_000), ahead).otherwise(nothing))
    if before_s:
        behind = F.struct((own + 1).alias("chunk"), F.lit(False).alias("own"))
        spots.append(
            F.when(offset >= F.lit(width - before_s * 1_000_000), behind).otherwise(nothing)
        )
    places = F.filter(F.array(*spots), lambda s: s.isNotNull())
    return (
        df.withColumn("_spot", F.explode(places))
        .withColumn("_chunk", F.col("_spot.chunk"))
        .withColumn("_own", F.col("_spot.own"))
        .drop("_spot")
    )


def range_window(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    aggregates: Mapping[str, tuple[Column, int, int]],
    width_s: int = DAY_SECONDS,
) -> DataFrame:
    """Aggregates over time frames of bounded length.

    aggregates: name -> (aggregate column, frame start, frame end), the frame in seconds
    relative to the row and inclusive on both ends; negative looks back.
    """
    ahead = max([0, *[hi for _, _, hi in aggregates.values()]])
    back = max([0, *[-lo for _, lo, _ in aggregates.values()]])
    width = max(width_s, ahead, back)
    spread = with_halo(df, keys, time, before_s=back, after_s=ahead, width_s=width)
    spread = spread.withColumn("_us", micros(F.col(time)))
    window = Window.partitionBy(*keys, "_chunk").orderBy("_us")
    columns = [
        agg.over(window.rangeBetween(lo * 1_000_000, hi * 1_000_000)).alias(name)
        for name, (agg, lo, hi) in aggregates.items()
    ]
    return (
        spread.select(*df.columns, "_own", *columns)
        .where("_own")
        .select(*df.columns, *aggregates.keys())
    )
