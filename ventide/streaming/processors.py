"""Readings as a stream: causal features and risk bands with per-stay state.

State lives in the state store under the query's checkpoint, so a restarted query carries on
where the last committed batch ended. It is kept as one JSON snapshot per stay. A reading
older than the last one accepted, or before ventilation began, cannot be applied without
rewriting history: it is emitted with a reason instead of features.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ventide import config as C
from ventide.operators import bands
from ventide.sources.schemas import schema

STATE = T.StructType([T.StructField("snapshot", T.StringType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Input of the feature stream: a reading, or a mode charted on its own.
READING_SCHEMA = schema(
    "stay_id int, charttime timestamp, vent_start timestamp, is_reading boolean,"
    " ventilator_mode string, " + ", ".join(f"{p} double" for p in C.PARAMS))
FEATURE_SCHEMA = schema(
    "stay_id int, charttime timestamp, rejected string, "
    + ", ".join(
        f"{p}_observed tinyint, {p}_delta_t_min double, {p}_locf double,"
        f" {p}_structurally_missing_in_stay tinyint, {p}_final double" for p in C.PARAMS)
    + ", ventilator_mode string, ventilator_mode_age_min double, vent_hours double")
# The same with the drug chart: an infusion is charted at its start, with its end and rate.
CHART_SCHEMA = T.StructType([*READING_SCHEMA, *schema("grp string, endtime timestamp, rate double")])
ROW_SCHEMA = T.StructType([*FEATURE_SCHEMA, *schema(", ".join(
    f"{g}_running tinyint, {g}_rate double, {g}_minutes_since_start double" for g in C.DRUG_GROUPS))])
SCORE_SCHEMA = schema("stay_id int, charttime timestamp, p double")
BAND_SCHEMA = schema(
    "stay_id int, charttime timestamp, rejected string, instant string, displayed string,"
    " band_state string, readings_in_state bigint")

INSTANTS = ("charttime", "vent_start", "endtime")
NUMBERS = (*C.PARAMS, "rate", "p")


def _minutes(t: pd.Timestamp) -> float:
    return t.value / 60e9


def _opened(row: Row) -> dict:
    """A row as the steps read it: instants, and no number as NaN."""
    out = row.asDict()
    for name in INSTANTS:
        if out.get(name) is not None:
            out[name] = pd.Timestamp(out[name], unit="us")
    for name in NUMBERS:
        if name in out and out[name] is None:
            out[name] = math.nan
    return out


class _Snapshot(StatefulProcessor):
    """Loads a stay's snapshot, steps through its rows in time order, stores it again.

    Rows come and go one by one, not as a small frame per stay, which costs more than the steps. Instants
    travel as microseconds, so that no worker's clock zone touches them.
    """

    fresh: dict = {}
    output: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._store = handle.getValueState("stay", STATE)

    def step(self, state: dict, row: dict) -> dict | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = sorted(map(_opened, rows), key=lambda row: (row["charttime"], not row.get("is_reading", True)))
        state = json.loads(self._store.get()[0]) if self._store.exists() else copy.deepcopy(self.fresh)
        out = [self.step(state, row) for row in batch]
        self._store.update((json.dumps(state),))
        made = Row(*self.output.fieldNames())
        for row in out:
            if row is not None:
                row["charttime"] = row["charttime"].value // 1000
                yield made(*[row[name] for name in self.output.fieldNames()])

    def close(self) -> None:
        pass


class FeatureProcessor(_Snapshot):
    """Carry-forward companions and ventilator mode, one reading at a time."""

    fresh = {"value": {}, "seen": {}, "mode": None, "mode_at": None, "pending": [], "last": None}
    output = FEATURE_SCHEMA

    def __init__(self, reference: dict[str, float | None]) -> None:
        self._reference = reference

    def step(self, state: dict, row: dict) -> dict | None:
        now = _minutes(row["charttime"])
        mode = row["ventilator_mode"]
        mode = mode if isinstance(mode, str) else None
        base = {"stay_id": row["stay_id"], "charttime": row["charttime"], "rejected": None}
        if not row["is_reading"]:
            latest = state["pending"][-1][0] if state["pending"] else state["mode_at"]
            if latest is not None and now < latest:
                return self._reject(base, "mode out of order")
            state["pending"].append([now, mode])
            return None
        if state["last"] is not None and now < state["last"]:
            return self._reject(base, "reading out of order")
        if not pd.isna(row["vent_start"]) and row["charttime"] < row["vent_start"]:
            return self._reject(base, "before ventilation")
        values, seen = state["value"], state["seen"]
        for p in C.PARAMS:
            observed = not pd.isna(row[p])
            if observed:
                values[p], seen[p] = float(row[p]), now
            age = now - seen[p] if p in seen else None
            locf = values[p] if age is not None and age <= C.LOCF_CUTOFF_MIN else None
            base |= {
                f"{p}_observed": int(observed), f"{p}_delta_t_min": age, f"{p}_locf": locf,
                f"{p}_structurally_missing_in_stay": int(p not in seen),
                f"{p}_final": self._reference.get(p) if locf is None else locf,
            }
        # A mode counts from the first reading after its own instant.
        pending, due = state["pending"], 0
        while due < len(pending) and pending[due][0] < now:
            due += 1
        if due:
            state["mode_at"], state["mode"] = pending[due - 1]
            del pending[:due]
        known = state["mode_at"] is not None
        began = row["vent_start"]
        base |= {
            "ventilator_mode": state["mode"],
            "ventilator_mode_age_min": now - state["mode_at"] if known else -1.0,
            "vent_hours": None if pd.isna(began) else (now - _minutes(began)) // 60.0,
        }
        state["last"] = now
        return base

    def _reject(self, base: dict, reason: str) -> dict:
        empty = dict.fromkeys(self.output.fieldNames())
        return empty | base | {"rejected": reason}


class RowProcessor(FeatureProcessor):
    """Features with the drug state: intervals that may still run are part of the stay's state.

    An interval counts for readings strictly after its start and strictly before its end. One that
    has ended at a reading can count for no later one and is forgotten there, so the state holds
    what is open and not what was ever given. Without an end an interval is never open.
    """

    fresh = FeatureProcessor.fresh | {"open": []}
    output = ROW_SCHEMA

    def step(self, state: dict, row: dict) -> dict | None:
        if isinstance(row["grp"], str):
            start, end = row["charttime"], row["endtime"]
            if not pd.isna(end) and end > start:
                rate = 0.0 if pd.isna(row["rate"]) else float(row["rate"])
                state["open"].append([row["grp"], _minutes(start), _minutes(end), rate])
            return None
        base = super().step(state, row)
        if base is None or base["rejected"] is not None:
            return base
        now = state["last"]
        state["open"] = [x for x in state["open"] if x[2] > now]
        running = {g: [x for x in state["open"] if x[0] == g and x[1] < now] for g in C.DRUG_GROUPS}
        for g, active in running.items():
            base |= {
                f"{g}_running": int(bool(active)), f"{g}_rate": math.fsum(x[3] for x in active),
                f"{g}_minutes_since_start": now // 1 - min(x[1] for x in active) // 1 if active else -1.0,
            }
        return base


class BandProcessor(_Snapshot):
    """Displayed band of each scored reading."""

    output = BAND_SCHEMA

    def __init__(self, machine: bands.Machine) -> None:
        self._machine = machine
        self.fresh = {"latches": [list(bands.FRESH) for _ in machine.cuts], "last": None,
                      "displayed": 0, "count": 0}

    def step(self, state: dict, row: dict) -> dict | None:
        m, now, p = self._machine, _minutes(row["charttime"]), row["p"]
        base = {"stay_id": row["stay_id"], "charttime": row["charttime"], "rejected": None}
        if state["last"] is not None and now < state["last"]:
            empty = dict.fromkeys(BAND_SCHEMA.fieldNames())
            return empty | base | {"rejected": "reading out of order"}
        gap = None if state["last"] is None else now - state["last"]
        state["latches"] = [
            list(bands.step(cut, floor, m.dwell, tuple(latch), p, now, gap))
            for cut, floor, latch in zip(m.cuts, m.floors, state["latches"], strict=True)
        ]
        lit = [latch[0] for latch in state["latches"]]
        if lit != sorted(lit, reverse=True):
            raise AssertionError(f"a latch is on above one that is off: {lit}")
        shown, instant = sum(lit), sum(p > cut for cut in m.cuts)
        state["count"] = state["count"] + 1 if shown == state["displayed"] else 1
        state |= {"displayed": shown, "last": now}
        kind = (bands.CONFIRMED if instant == shown
                else bands.PROVISIONAL if instant > shown else bands.DEMOTING)
        return base | {"instant": m.names[instant], "displayed": m.names[shown],
                       "band_state": kind, "readings_in_state": state["count"]}


def _stateful(stream: DataFrame, processor: _Snapshot) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ticks = stream.withColumns({c: F.unix_micros(c) for c in INSTANTS if c in stream.columns})
    layout = T.StructType([T.StructField(f.name, T.LongType() if f.name in INSTANTS else f.dataType) for f in processor.output])
    told = ticks.groupBy("stay_id").transformWithState(
        statefulProcessor=processor, outputStructType=layout, outputMode="Append", timeMode="None")
    return told.withColumn("charttime", F.timestamp_micros("charttime"))


def feature_stream(stream: DataFrame, reference: dict[str, float | None]) -> DataFrame:
    """Feature rows of a stream with READING_SCHEMA."""
    return _stateful(stream, FeatureProcessor(reference))


def row_stream(stream: DataFrame, reference: dict[str, float | None]) -> DataFrame:
    """Feature rows with drug state of a stream with CHART_SCHEMA."""
    return _stateful(stream, RowProcessor(reference))


def band_stream(stream: DataFrame, machine: bands.Machine) -> DataFrame:
    """Band views of a stream with SCORE_SCHEMA."""
    return _stateful(stream, BandProcessor(machine))


def read_stream(spark: SparkSession, path: str, layout: T.StructType, files: int = 64) -> DataFrame:
    """New files as a stream, at most `files` of them in one micro-batch, so that a backlog is not
    one batch."""
    return spark.readStream.schema(layout).option("maxFilesPerTrigger", files).parquet(path)


def run_available(result: DataFrame, output: str, checkpoint: str) -> None:
    """Process what has arrived so far, commit it to Parquet and stop."""
    query = (
        result.writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def split_results(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and the dead letters."""
    return (result.where("rejected IS NULL").drop("rejected"),
            result.where("rejected IS NOT NULL").select("stay_id", "charttime", "rejected"))
