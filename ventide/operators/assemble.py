"""Feature matrix: readings with drug state, static features and split, plus its guards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators.labels import label_columns

CATEGORICAL = ("gender", "admission_type", "admission_location", "insurance", "language",
               "marital_status", "race", "first_careunit", "ventilator_mode")
KEYS = ("stay_id", "subject_id", "charttime")


def static_features(static: DataFrame) -> DataFrame:
    """The static columns a model may see: nothing known only afterwards."""
    after = [c for c in static.columns if c.startswith("leaky_")]
    return static.drop(*after, "vent_start", "vent_end", "subject_id", "hadm_id")


def assemble(imputed: DataFrame, interventions: DataFrame, static: DataFrame,
             split: DataFrame, flags: C.Flags = C.Flags()) -> DataFrame:
    """One row per reading. All right-hand sides are unique on their key.

    The joins on stay and patient would send a long stay to one task; they are left to
    Spark's broadcast (size-checked) and its run-time splitting of skewed joins.
    """
    matrix = (
        imputed.join(interventions, ["stay_id", "charttime"], "left")
        .join(static_features(static), "stay_id", "left")
        .join(split.select("subject_id", "split", "fold"), "subject_id", "left")
    )
    if flags.predicted_body_weight and "pbw_kg" in matrix.columns:
        per_kg = F.when(
            F.col("pbw_kg") > 0, F.col("tidal_volume_observed_final") / F.col("pbw_kg")
        )
        matrix = matrix.withColumn("tidal_volume_ml_per_kg_pbw", per_kg)
    return matrix


def guards(matrix: DataFrame, imputed: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Checks of an assembled matrix as rows (check, ok, detail)."""
    since = [c for c in matrix.columns if c.endswith("_minutes_since_start")]
    late = [F.count_if((F.col(c) != -1) & (F.col(c) <= 0)).alias(c) for c in since]
    seen = matrix.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("stay_id").alias("stays"),
        F.count_if(F.col("charlson_index").isNull()).alias("unmatched"),
        *late,
    )
    base = imputed.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("stay_id").alias("stays"))
    banned = set(matrix.columns) & (label_columns(labels) if labels is not None else set())
    banned |= {c for c in matrix.columns if c.startswith("leaky_")}
    started_late = sum((F.col(c) for c in since), F.lit(0))
    checks = [
        ("row count unchanged", F.col("rows") == base.select("rows").scalar(),
         F.col("rows")),
        ("stay count unchanged", F.col("stays") == base.select("stays").scalar(),
         F.col("stays")),
        ("static coverage", F.col("unmatched") <= F.col("rows") * 0.01, F.col("unmatched")),
        ("interventions strictly before", started_late == 0, started_late),
        ("no label or later column", F.lit(not banned), F.lit(len(banned))),
    ]
    return seen.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(name).alias("check"), ok.alias("ok"),
                           detail.cast("long").alias("detail")) for name, ok, detail in checks]
            )
        )
    )


def manifest(matrix: DataFrame, interventions: DataFrame, static: DataFrame,
             settings: C.Settings = C.Settings()) -> dict:
    """Which columns are features, where they come from, and the named feature sets."""
    columns = [c for c in matrix.columns if c not in {*KEYS, "split", "fold", "warning"}]
    t3 = [c for c in interventions.columns if c not in KEYS and c in columns]
    t1 = [c for c in static_features(static).columns if c != "stay_id" and c in columns]
    t2 = [c for c in columns
          if c not in {*t3, *t1} and c not in C.PARAMS]
    documentation = [c for c in t2 if c.endswith(C.COMPANIONS[0]) or c.endswith(C.COMPANIONS[1])
                     or c.endswith(C.COMPANIONS[3])]
    final = [c for c in t2 if c.endswith("_final")]
    full = t2 + t1 + t3
    return {
        "target": settings.target,
        "group_key": "subject_id",
        "categorical": [c for c in CATEGORICAL if c in full],
        "groups": {"timeseries": t2, "static": t1, "interventions": t3},
        "sets": {"documentation": documentation, "final": final, "timeseries": t2, "full": full},
        "fingerprint": settings.fingerprint(),
    }


def feature_kind(feature: str, man: dict) -> tuple[str, str]:
    """(kind, source group) of a feature, from the manifest."""
    kind = "documentation" if feature in man["sets"]["documentation"] else "physiology"
    for group, members in man["groups"].items():
        if feature in members:
            return kind, group
    return kind, "unknown"


def align_labels(matrix: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """Add the target on the reading key and drop readings whose label is unknown."""
    return matrix.join(
        labels.select("stay_id", "charttime", F.col(target).alias("y")), ["stay_id", "charttime"]
    ).where(F.col("y").isNotNull())


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that occur more than once; empty when the join key is sound."""
    keys = list(keys)
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def column_health(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Filled and distinct counts per column in one pass: dead and constant columns."""
    columns = list(columns)
    measured = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"{c}:n") for c in columns],
        *[F.max(F.col(c).cast("string")).alias(f"{c}:max") for c in columns],
        *[F.min(F.col(c).cast("string")).alias(f"{c}:min") for c in columns],
    )
    return measured.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.col(f"`{c}:n`").alias("filled"),
                        (F.col(f"`{c}:n`") == 0).alias("dead"),
                        F.coalesce(F.col(f"`{c}:min`") == F.col(f"`{c}:max`"), F.lit(False))
                        .alias("constant"),
                    )
                    for c in columns
                ]
            )
        )
    )


def filled_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Filled values per column, one row each, from one pass that only counts."""
    columns = list(columns)
    return df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "column", "filled")


def category_levels(df: DataFrame, columns: Iterable[str] = CATEGORICAL) -> DataFrame:
    """Distinct levels per categorical column: what a serving model must be told to expect."""
    present = [c for c in columns if c in df.columns]
    long = df.select(*[F.col(c).cast("string").alias(c) for c in present]).unpivot(
        [], present, "column", "level")
    return long.where(F.col("level").isNotNull()).groupBy("column", "level").agg(
        F.count(F.lit(1)).alias("rows"))


def unknown_levels(df: DataFrame, levels: DataFrame, columns: Iterable[str] = CATEGORICAL
                   ) -> DataFrame:
    """Levels that occur in `df` but were not frozen: a model must not be given them."""
    return category_levels(df, columns).join(levels, ["column", "level"], "left_anti")
