"""All hysteresis settings and all cuts of the search in one pass over the readings.

A setting's cuts are solved against promotion budgets on a grid of scores. Each (setting, cut) is a
latch, and a setting's latches are nested: a score that has stayed above a cut for long enough has
stayed above every lower one, and one below a floor is below every higher floor. So a reading tells the
lowest `on` latches to switch on and those from `off` upwards to switch off, and what is on is always
the lowest `lit` latches: lit = max(on, min(lit before, off)). Two numbers a reading and setting stand
for all cuts, and the cuts a reading switches on are one interval.

Triggers do not depend on the latches. So a chunk of a stay needs nothing from the one before but the
rows its runs look back on, and tells three numbers a setting: how many latches are told on before they
are told off (`led`), the smallest `off`, and `lit` if nothing was on before. Chunks of a stay are put
together in order from these, which takes back the switches that had been made before.

Three passes solve three boundaries for every setting (a boundary's floor needs the cut below it).
One more evaluates every solved machine. Nothing is searched by jobs from the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.quantile import quantiles
from ventide.functions.timefn import micros
from ventide.operators import bands
from ventide.operators.bands import Dwell, Machine
from ventide.operators.scan import DAY_SECONDS, with_halo
from ventide.session import materialize

PORTION = 1 << 14  # rows that a task works on at once, or one chunk if it is longer


@dataclass(frozen=True)
class Latches:
    """Latches of settings (rows) and cuts (columns): arrays that broadcast to settings x cuts."""

    cuts: np.ndarray
    floors: np.ndarray
    up_min: np.ndarray
    up_readings: np.ndarray
    down_min: np.ndarray
    max_gap: float

    @classmethod
    def of(cls, dwells: Sequence[Dwell], cuts: np.ndarray, below: np.ndarray) -> Latches:
        """`cuts`: settings x cuts or 1 x cuts; `below`: what each lets go towards, alike."""
        gaps = {d.max_gap_min for d in dwells}
        if len(gaps) != 1:
            raise ValueError("settings of one sweep share their charting gap")
        column = lambda name: np.array([getattr(d, name) for d in dwells], float)[:, None]
        floors = cuts - column("demote_margin") * (cuts - below)
        if (np.diff(cuts) < 0).any() or (np.diff(floors) < 0).any():
            raise ValueError("cuts and floors must ascend")
        return cls(cuts, floors, column("promote_min"), column("promote_readings"), column("demote_min"), gaps.pop())

    @property
    def shape(self) -> tuple[int, int]:
        return np.broadcast_shapes(self.cuts.shape, self.floors.shape, self.up_min.shape)

    def told(self, t: np.ndarray, p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settings x readings: how many of the lowest latches are told to switch on, and from which one
        up they are told to switch off. `starts`: where each stay and chunk begins."""
        fresh = np.zeros(len(t), bool)
        fresh[starts] = True
        fresh[1:] |= t[1:] - t[:-1] > self.max_gap
        at = np.arange(len(t))
        run = np.maximum.accumulate(np.where(fresh, at, 0))  # where the unbroken run of readings began
        n, settings = self.shape[1], self.shape[0]
        on, off = np.zeros((settings, len(t)), np.int32), np.full((settings, len(t)), n, np.int32)
        spans, above, under = {}, {}, {}

        def span(minutes: float, readings: int) -> np.ndarray:
            """The latest reading a run must reach back to, -1 without one."""
            if (minutes, readings) not in spans:
                back = _reach(t, starts, minutes)
                back = np.minimum(back, at - int(readings) + 1)
                spans[minutes, readings] = np.where(back >= run, back, -1)
            return spans[minutes, readings]

        def rows(values: np.ndarray) -> np.ndarray:
            return np.broadcast_to(values, (settings, values.shape[1]))

        unknown = np.isnan(p)  # neither above a cut nor below a floor

        for i, (cuts, floors) in enumerate(zip(rows(self.cuts), rows(self.floors))):
            up = (cuts.tobytes(), self.up_min[i, 0], self.up_readings[i, 0])
            if up not in above:
                passed = np.where(unknown, 0, np.searchsorted(cuts, p)).astype(np.int32)
                above[up] = _over_runs(np.minimum, passed, span(*up[1:]), 0)
            down = (floors.tobytes(), self.down_min[i, 0])
            if down not in under:
                under[down] = _over_runs(np.maximum, np.searchsorted(floors, p, side="right").astype(np.int32), span(down[1], 1), n)
            on[i], off[i] = above[up], under[down]
        return on, off


def _reach(t: np.ndarray, starts: np.ndarray, minutes: float) -> np.ndarray:
    """Per reading the latest one of its group, itself included, that is at least `minutes` older; -1 without one."""
    at, begin = np.arange(len(t)), np.repeat(starts, np.diff(np.append(starts, len(t))))
    since = t - t[begin]
    clock = since + np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t)))) * (since.max(initial=0) + minutes + 1)
    place = np.minimum(np.searchsorted(clock, clock - minutes, side="right") - 1, at)
    # The clock of all groups is rounded; the difference decides, as in `bands.step`.
    while (near := (place < at) & (t - t[np.minimum(np.maximum(place + 1, begin), at)] >= minutes)).any():
        place[near] = np.maximum(place + 1, begin)[near]
    while (far := (place >= begin) & (t - t[np.maximum(place, begin)] < minutes)).any():
        place[far] -= 1
    return np.where(place >= begin, place, -1)


def _over_runs(fold: np.ufunc, values: np.ndarray, back: np.ndarray, none: int) -> np.ndarray:
    """min or max of the values from `back` to each reading, `none` where there is no such run."""
    out = np.full(len(values), none, values.dtype)
    at = np.flatnonzero(back >= 0)
    low, width, level = back[at], 1, values
    size = at - low + 1
    while len(at):
        now = size < 2 * width  # two overlapping stretches of `width` cover it
        out[at[now]] = fold(level[low[now]], level[at[now] - width + 1])
        at, low, size = at[~now], low[~now], size[~now]
        if len(at):
            level = fold(level[:-width], level[width:])
            width *= 2
    return out


def _lit(on: np.ndarray, off: np.ndarray, starts: np.ndarray, lit: np.ndarray) -> np.ndarray:
    """Latches that are on after every row (columns), from `lit` before each group's first one. Groups
    step side by side."""
    out = np.empty_like(on)
    lengths = np.diff(np.append(starts, on.shape[1]))
    order = np.argsort(-lengths, kind="stable")
    first, ascending, lit = starts[order], lengths[order][::-1], lit[:, order]
    for step in range(int(lengths.max(initial=0))):
        live = len(ascending) - np.searchsorted(ascending, step, side="right")
        at = first[:live] + step
        lit = np.maximum(on[:, at], np.minimum(lit[:, :live], off[:, at]))
        out[:, at] = lit
    return out


def _before(lit: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Latches that were on at the row before, `first` before a group's first row."""
    out = np.empty_like(lit)
    out[:, 1:] = lit[:, :-1]
    out[:, starts] = first
    return out


def chunked(readings: DataFrame, dwells: Sequence[Dwell], width_s: int = DAY_SECONDS) -> DataFrame:
    """Readings with what each chunk looks back on, written once for all passes."""
    back = max(bands._lookback_seconds(d) for d in dwells)
    spread = with_halo(readings, ["stay_id"], "charttime", before_s=back, width_s=max(width_s, back))
    label = F.col("y") if "y" in readings.columns else F.lit(None)
    return materialize(spread.select(
        F.col("stay_id").cast("long").alias("stay_id"), F.col("_chunk").cast("long").alias("chunk"), F.col("_own").alias("own"),
        (micros(F.col("charttime")) / F.lit(60_000_000.0)).alias("t"), F.col("p").cast("double").alias("p"),
        F.coalesce(label, F.lit(0)).cast("int").alias("y")))


def _in_order(chunks: DataFrame) -> DataFrame:
    return chunks.repartition("stay_id", "chunk").sortWithinPartitions("stay_id", "chunk", "t")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _portions(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray], pa.Table]]:
    """About PORTION rows of whole groups at a time: where each group begins, the columns as arrays, the rows."""
    def opened(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
        table = table.combine_chunks()
        return _changes(*(table.column(k).to_numpy() for k in keys)), table

    def portion(starts: np.ndarray, table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Table]:
        plain = [c for c in table.column_names if not pa.types.is_binary(table.schema.field(c).type)]
        return starts, {c: table.column(c).to_numpy() for c in plain}, table

    held: list[pa.RecordBatch] = []
    count, enough = 0, PORTION
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < enough:
            continue
        starts, table = opened(pa.Table.from_batches(held))
        last = int(starts[-1])
        if last:
            yield portion(starts[:-1], table.slice(0, last))
        held = table.slice(last).to_batches()
        count = table.num_rows - last
        enough = max(PORTION, 2 * count)  # one long group is not looked through again with every batch
    if held:
        yield portion(*opened(pa.Table.from_batches(held)))


_EDGES = "stay_id long, chunk long, edge binary, total array<long>"
_EDGE_NAMES = [c.split()[0] for c in _EDGES.split(", ")]


def _edge_rows(stay: np.ndarray, chunk: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
    """One row per stay and chunk; `edge`: three numbers x settings x chunks."""
    edge = np.ascontiguousarray(np.moveaxis(edge, -1, 0).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(stay), pa.array(chunk), pa.array([e.tobytes() for e in edge], pa.binary()),
         pa.nulls(len(stay), pa.list_(pa.int64()))], names=_EDGE_NAMES)


def _total_row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
         pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=_EDGE_NAMES)


def _between(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Settings x cuts: how many of a setting's intervals [low, high) hold each cut."""
    steps = np.zeros((len(low), n + 1), np.int64)
    some = low < high
    for step, lows, highs, pick in zip(steps, low, high, some):
        step += np.bincount(lows[pick], minlength=n + 1) - np.bincount(highs[pick], minlength=n + 1)
    return steps.cumsum(1)[:, :n]


def _own(latches: Latches, starts: np.ndarray, rows: dict[str, np.ndarray]
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the chunks' own rows are told, where these rows are and where each chunk begins among them."""
    on, off = latches.told(rows["t"], rows["p"], starts)
    own = np.flatnonzero(rows["own"])
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows["t"]))))[own]
    return on[:, own], off[:, own], own, group


def _edges(chunks: DataFrame, latches: Latches) -> DataFrame:
    """Per chunk and setting `led`, the smallest `off` and the last `lit`; and per task the switches inside
    its chunks, counted as if nothing was on before."""
    n = latches.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(latches.shape, np.int64)
        for starts, rows, _ in _portions(batches, "stay_id", "chunk"):
            on, off, own, group = _own(latches, starts, rows)
            if not len(own):  # chunks of copies only
                continue
            first = _changes(group)
            none = np.zeros((len(on), len(first)), on.dtype)
            lit = _lit(on, off, first, none)
            total += _between(_before(lit, first, none), on, n)
            # Running minimum of `off` in every chunk: later chunks lie below all values of earlier ones.
            shift = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own)))) * (n + 1)
            least = np.minimum.accumulate(off - shift, axis=1) + shift
            led = np.maximum.reduceat(np.minimum(on, _before(least, first, np.full_like(none, n))), first, axis=1)
            last = np.append(first[1:], len(own)) - 1
            yield _edge_rows(rows["stay_id"][own[first]], rows["chunk"][own[first]],
                             np.stack([led, least[:, last], lit[:, last]]))
        yield _total_row(total)

    return materialize(_in_order(chunks).mapInArrow(run, _EDGES))


def _by_stay(edges: DataFrame) -> DataFrame:
    told = edges.where("stay_id IS NOT NULL").select("stay_id", "chunk", "edge")
    return told.repartition("stay_id").sortWithinPartitions("stay_id", "chunk")


def _carried(table: pa.Table, starts: np.ndarray, settings: int) -> tuple[np.ndarray, np.ndarray]:
    """Settings x chunks: what was on before each chunk, and `led`."""
    edge = np.stack([np.frombuffer(e, np.int32) for e in table.column("edge").to_pylist()], -1)
    led, least, last = edge.reshape(3, settings, -1)
    none = np.zeros((settings, len(starts)), led.dtype)
    return _before(_lit(last, least, starts, none), starts, none), led


def promotions(chunks: DataFrame, latches: Latches) -> np.ndarray:
    """How often each latch switches on over all stays: settings x cuts."""
    edges, shape = _edges(chunks, latches), latches.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for starts, _, table in _portions(batches, "stay_id"):
            before, led = _carried(table, starts, shape[0])
            total -= _between(np.zeros_like(led), np.minimum(before, led), shape[1])  # these were on already
        yield _total_row(total)

    both = edges.where("stay_id IS NULL").unionByName(_by_stay(edges).mapInArrow(run, _EDGES))
    sums = both.select(F.posexplode("total").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()  # one a latch
    out = np.zeros(shape[0] * shape[1], np.int64)
    for row in sums:
        out[row["at"]] = row["n"]
    return out.reshape(shape)


def search(rates: np.ndarray, budget: float, coarse: int = C.BUDGET_COARSE_POINTS) -> tuple[int, int]:
    """Places of the lowest rate within the budget, and of the one below it that breaks it.

    The rate over the cuts is a hump, and only its high side counts: coarse steps from the top down
    to the first cut that breaks the budget, then halving.
    """
    good = bad = None
    for at in np.linspace(len(rates) - 1, 0, coarse).astype(int).tolist():
        if rates[at] > budget:
            bad = at
            break
        good = at
    if good is None:
        raise ValueError(f"budget {budget}/day is exceeded even at the highest cut")
    if bad is None:
        raise ValueError(f"budget {budget}/day never binds")
    while good - bad > 1:
        middle = (good + bad) // 2
        good, bad = (middle, bad) if rates[middle] <= budget else (good, middle)
    return good, bad


def solve(chunks: DataFrame, grid: Sequence[float], days: float, dwells: Sequence[Dwell],
          budgets: Sequence[float] = C.BAND_BUDGETS) -> list[dict]:
    """Per setting its solved boundaries (cut, rate, and the cut below with its rate), or why it has none."""
    cuts = np.asarray(grid, float)[None]
    out = [{"dwell": d, "solved": [], "rejected": None} for d in dwells]
    for budget in budgets:
        open_ = [r for r in out if r["rejected"] is None]
        if not open_:
            break
        below = np.array([[r["solved"][-1]["cut"] if r["solved"] else 0.0] for r in open_])
        rates = promotions(chunks, Latches.of([r["dwell"] for r in open_], cuts, below)) / days
        for result, rate in zip(open_, rates):
            try:
                good, bad = search(rate, budget)
            except ValueError as error:
                result["rejected"] = str(error)
                continue
            result["solved"].append({"cut": grid[good], "promotions_per_day": float(rate[good]), "budget": budget,
                                     "cut_just_below": grid[bad], "rate_just_below": float(rate[bad])})
    for result in out:
        if result["rejected"] is None:
            try:
                result["machine"] = Machine(tuple(s["cut"] for s in result["solved"]), result["dwell"],
                                            C.BAND_NAMES[:len(budgets) + 1])
            except ValueError as error:
                result["rejected"] = str(error)
    return out


def evaluate(readings: DataFrame, chunks: DataFrame, machines: Sequence[Machine]) -> DataFrame:
    """One row per machine: setting (its place), flips per day, detection at the second band from above,
    and minutes of warning lost, for all stays and for those with a positive label."""
    dwells = [m.dwell for m in machines]
    cuts = np.array([m.cuts for m in machines])
    below = np.concatenate([np.zeros((len(machines), 1)), cuts[:, :-1]], 1)
    latches, high = Latches.of(dwells, cuts, below), len(machines[0].names) - 2
    shape = latches.shape
    edges = _edges(chunks, latches)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, rows, table in _portions(batches, "stay_id"):
            before, _ = _carried(table, starts, shape[0])
            opens = np.zeros(before.shape[1], bool)
            opens[starts] = True
            begins = [b.tobytes() for b in np.ascontiguousarray(before.T)]
            yield pa.RecordBatch.from_arrays([pa.array(rows["stay_id"]), pa.array(rows["chunk"]), pa.array(begins, pa.binary()),
                                              pa.array(opens)], names=["stay_id", "chunk", "begins", "opens"])

    begun = _by_stay(edges).mapInArrow(carry, "stay_id long, chunk long, begins binary, opens boolean")
    layout = "setting int, stay_id long, raw double, shown double, flips long, positives long, caught long"

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shape[0]
        flips, caught, positives = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        for starts, rows, table in _portions(batches, "stay_id", "chunk"):
            on, off, own, group = _own(latches, starts, rows)
            if not len(own):
                continue
            first = _changes(group)
            head = own[first]
            begins = table.column("begins").take(pa.array(head)).to_pylist()
            begins = np.stack([np.frombuffer(b, np.int32) for b in begins], -1)
            level = _lit(on, off, first, begins)
            changed = level != _before(level, first, begins)
            changed[:, first[rows["opens"][head]]] = False  # a stay's first reading changes nothing
            flips += changed.sum(1)
            positive = rows["y"][own] == 1
            positives += int(positive.sum())
            caught += (level[:, positive] >= high).sum(1)
            t, p = rows["t"][own], rows["p"][own]
            # More cuts than `high` - 1 lie below the score: always, if no cut has to.
            instant = (p > cuts[:, high - 1:high]) if high > 0 else np.ones(level.shape, bool)
            raw, shown = (np.minimum.reduceat(np.where(x, t, np.inf), first, axis=1) for x in (instant, level >= high))
            setting, chunk = np.nonzero(np.isfinite(raw) | np.isfinite(shown))
            if len(setting):
                pick = lambda x: pa.array(x[setting, chunk], mask=~np.isfinite(x[setting, chunk]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(setting.astype(np.int32)), pa.array(rows["stay_id"][head][chunk]), pick(raw), pick(shown),
                     *[pa.nulls(len(setting), pa.int64())] * 3], names=names)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32)), none, pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(flips),
             pa.array(np.full(n, positives)), pa.array(caught)], names=names)

    names = [c.split()[0] for c in layout.split(", ")]
    seen = materialize(_in_order(chunks.join(begun, ["stay_id", "chunk"])).mapInArrow(view, layout))
    totals = seen.where("stay_id IS NULL").groupBy("setting").agg(
        *[F.sum(c).alias(c) for c in ("flips", "positives", "caught")])
    ends = readings.groupBy(F.col("stay_id").cast("long").alias("stay_id")).agg(
        (micros(F.max("charttime")) / F.lit(60_000_000.0)).alias("end"), F.max("y").alias("any"))
    first = seen.where("stay_id IS NOT NULL").groupBy("setting", "stay_id").agg(F.min("raw").alias("raw"), F.min("shown").alias("shown"))
    lost = materialize(first.where("raw IS NOT NULL").join(ends, "stay_id").select(
        "setting", "any", (F.coalesce("shown", "end") - F.col("raw")).alias("lost")))
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("quantile")))
    every = quantiles(lost, ["setting"], "lost", [0.5, 0.9]).groupBy("setting").agg(
        at(0.5).alias("lost_lead_median_min"), at(0.9).alias("lost_lead_p90_min"))
    positive = quantiles(lost.where(F.col("any") == 1), ["setting"], "lost", [0.5]).groupBy("setting").agg(
        at(0.5).alias("lost_lead_median_min_positive"))
    days = bands.patient_days(readings).scalar()
    joined = totals.join(every, "setting", "left").join(positive, "setting", "left")
    return joined.select(
        "setting", (F.col("flips") / days).alias("flips_per_day"), F.try_divide("caught", "positives").alias("sensitivity_high"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lost_lead_median_min", "lost_lead_p90_min", "lost_lead_median_min_positive")])


def sweep(readings: DataFrame, dwells: Sequence[Dwell], budgets: Sequence[float] = C.BAND_BUDGETS,
          points: int = C.BUDGET_GRID_POINTS, width_s: int = DAY_SECONDS) -> list[dict]:
    """Every setting with its solved cuts and what they do, or why it was rejected; the chosen one is
    marked. Readings: stay_id, charttime, p, y."""
    readings = materialize(readings)
    chunks = chunked(readings, dwells, width_s)
    results = solve(chunks, bands.score_grid(readings, points), bands.patient_days(readings).first()["days"], dwells, budgets)
    usable = [r for r in results if r["rejected"] is None]
    if usable:
        for row in evaluate(readings, chunks, [r["machine"] for r in usable]).collect():  # one a setting
            usable[row["setting"]].update({k: v for k, v in row.asDict().items() if k != "setting"})
        best = bands.choose(usable)
        for r in usable:
            r["chosen"] = r is best
    return results
