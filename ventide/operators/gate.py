"""Gate: changes of the published build are accepted one after the other, or reverted.

A state is a set of accepted changes. It is measured by two scores of the same test rows, one from all
features (`full`) and one from what was charted when (`documentation`); their paired difference on
resampled patients is what the values themselves contribute. A change stays if that contribution did not
fall by more than resampling explains and the documentation's share of the skill did not rise. The level of
average precision alone decides nothing: its floor is the positive rate, which a change of the target moves.

Every further state is built on the last accepted one, so a state is fitted only when it is reached.
The driver holds a handful of numbers a state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators import heads, models
from ventide.session import materialize

FULL, DOCUMENTATION = "full", "documentation"
NAMES = (FULL, DOCUMENTATION)
#: Comparisons are made on this many decimals, so that a change without effect is never a loss.
DECIMALS = 9


@dataclass(frozen=True)
class Measured:
    """One state. `d_` are means and bounds of full minus documentation on resampled patients."""

    rows: int
    positive_rate: float
    ap_full: float
    ap_documentation: float
    auc_full: float
    auc_documentation: float
    ap_skill: float
    doc_share: float
    d_ap: float
    d_ap_lo: float
    d_ap_hi: float
    d_auc: float
    d_auc_lo: float
    d_auc_hi: float


@dataclass(frozen=True)
class Trial:
    step: str
    built_on: str
    decision: str
    ap_change: str
    auc_change: str
    share_change: str
    measured: Measured


TRIAL_SCHEMA = ("place int, step string, built_on string, decision string, ap_change string, auc_change string, share_change string, "
                + ", ".join(f"{f} {'bigint' if f == 'rows' else 'double'}" for f in Measured.__dataclass_fields__))


def measure(rows: DataFrame, cluster: str, n: int = 200, seed: int = C.SEED) -> Measured:
    """`rows` is `heads.frame` over NAMES: both scores on the rows that have both."""
    rows = materialize(rows)
    level = {r["head"]: r for r in heads.head_metrics(rows, NAMES).collect()}
    if set(level) != set(NAMES) or level[FULL]["ap"] is None or level[FULL]["auc"] is None:
        raise ValueError("a state needs test rows of both labels that both scores know")
    replicates = heads.head_replicates(rows, NAMES, cluster, n, seed)
    delta = {r["metric"]: r for r in heads.head_differences(replicates, FULL).collect()}
    full, doc, rate = level[FULL], level[DOCUMENTATION], level[FULL]["positive_rate"]
    told = {f"d_{m}{end}": round(delta[m][c], DECIMALS) for m in ("ap", "auc")
            for end, c in (("", "mean"), ("_lo", "lo"), ("_hi", "hi"))}
    return Measured(
        rows=full["rows"], positive_rate=rate, ap_full=full["ap"], ap_documentation=doc["ap"], auc_full=full["auc"],
        auc_documentation=doc["auc"], ap_skill=(full["ap"] - rate) / (1.0 - rate),
        doc_share=round((doc["ap"] - rate) / max(full["ap"] - rate, 1e-12), DECIMALS), **told)


def compare(new: Measured, base: Measured, tolerance: float = C.GATE_SHARE_TOLERANCE) -> tuple[str, str, str]:
    """What became of AP, AUC (held, noise, worse) and the documentation's share (held, worse)."""
    def change(metric: str) -> str:
        was, now, high = getattr(base, f"d_{metric}"), getattr(new, f"d_{metric}"), getattr(new, f"d_{metric}_hi")
        return "held" if now >= was else "noise" if high >= was else "worse"

    risen = round(new.doc_share - base.doc_share, DECIMALS) > tolerance
    return change("ap"), change("auc"), "worse" if risen else "held"


def run(steps: Iterable[tuple[str, Mapping[str, object]]], measured: Callable[[dict[str, object]], Measured],
        tolerance: float = C.GATE_SHARE_TOLERANCE) -> list[Trial]:
    """Try `steps` (name, changes) in order. `measured` gets all changes of a state; the first is the baseline."""
    trials: list[Trial] = []
    kept: dict[str, object] = {}
    base: Trial | None = None
    for name, changes in steps:
        state = {**kept, **changes}
        found = measured(state)
        if base is None:
            trial = Trial(name, "", "baseline", "held", "held", "held", found)
        else:
            verdict = compare(found, base.measured, tolerance)
            trial = Trial(name, base.step, "reject" if "worse" in verdict else "accept", *verdict, found)
        if trial.decision != "reject":
            base, kept = trial, state
        trials.append(trial)
    return trials


def as_table(spark: SparkSession, trials: Sequence[Trial]) -> DataFrame:
    rows = [(i, t.step, t.built_on, t.decision, t.ap_change, t.auc_change, t.share_change, *asdict(t.measured).values())
            for i, t in enumerate(trials)]
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


# ------------------------------------------------------------ fits of a state
def fit_pair(df: DataFrame, numeric: Sequence[str], documentation: Sequence[str], categorical: Sequence[str] = (),
             cluster: str = "subject_id", **params) -> DataFrame:
    """`heads.frame` of the test rows under two fits on the same training rows, each mapped to levels on a fold of its own.

    `df` has the features, y, split and fold. Both scores are put on one frame, so they cannot be about different rows.
    """
    both = list(dict.fromkeys([*numeric, *documentation]))
    known = df.where("y IS NOT NULL").select(cluster, F.col("y").cast("double").alias("y"), "split", "fold", *both, *categorical)
    known = materialize(models.filled(known, both, categorical))
    train, test = known.where("split = 'train'"), known.where("split = 'test'")
    weight = models.class_weight(train)
    for name, features, categories in ((FULL, list(numeric), list(categorical)), (DOCUMENTATION, list(documentation), [])):
        model = models.fit_gbt(train, features, categories, stop_fold=heads.STOP_FOLD, weight=weight, **params)
        held = models.score(model, train.where(F.col("fold") == heads.MAP_FOLD), features, categories)
        slope, intercept = models.fit_platt(held.select("y", "p"))
        made = ["p", "features", *[f"_i_{c}" for c in categories]]
        test = models.score(model, test, features, categories).withColumn(
            name, models.apply_platt(F.col("p"), slope, intercept)).drop(*made)
    return heads.frame(test, NAMES, cluster)
