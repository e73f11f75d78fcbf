"""The whole feature row of a live system: what a model was trained with, and rows checked against it.

The stateful processors supply what changes with each reading. Everything known per stay is a
static table joined to their output, so no state is spent on it. A row leaves only with the columns
of the training matrix, in their order, and with levels the model has seen.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators.assemble import category_levels, feature_kind, static_features
from ventide.sources.io import read_document, write_document

#: A categorical column with more levels than this is an identifier, not a category.
MOST_LEVELS = 1000


@dataclass(frozen=True)
class Assets:
    """What serving must know besides the model: column order, levels, training medians, kinds."""

    features: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]
    medians: dict[str, float | None]
    kinds: dict[str, tuple[str, str]]
    fingerprint: str

    def save(self, spark: SparkSession, path: str) -> None:
        write_document(spark, path, asdict(self))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Assets:
        d = read_document(spark, path)
        return cls(tuple(d["features"]), {c: tuple(v) for c, v in d["levels"].items()}, d["medians"],
                   {f: tuple(k) for f, k in d["kinds"].items()}, d["fingerprint"])


def freeze(matrix: DataFrame, man: dict, medians: dict[str, float | None], most: int = MOST_LEVELS) -> Assets:
    """Assets of a training matrix with its manifest. More than `most` levels in a column are refused."""
    columns = man["categorical"]
    counts = matrix.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
    wide = [c for c in columns if counts[c] > most]
    if wide:
        raise ValueError(f"columns with more than {most} levels: {wide}")
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in category_levels(matrix, columns).select("column", "level").collect():  # at most `most` a column
        found[row["column"]].append(row["level"])
    full = man["sets"]["full"]
    return Assets(tuple(full), {c: tuple(sorted(v)) for c, v in found.items()}, dict(medians),
                  {f: feature_kind(f, man) for f in full}, man["fingerprint"])


def static_row(static: DataFrame) -> DataFrame:
    """The static features a live system knows. Ventilation hours are not among them: they are
    counted up to each reading."""
    return static_features(static).drop("vent_hours")


def complete(rows: DataFrame, static: DataFrame, assets: Assets, flags: C.Flags = C.Flags()) -> DataFrame:
    """Rows of the feature stream as rows of the matrix: stay_id, charttime, rejected, features.

    The columns are compared with the assets before anything runs. A stay without a static row, or
    with a level the model has not seen, is rejected by reason and carries no features.
    """
    known = static_row(static).withColumn("_static", F.lit(True))
    joined = rows.join(known, "stay_id", "left")
    if flags.predicted_body_weight and "pbw_kg" in joined.columns:
        joined = joined.withColumn("tidal_volume_ml_per_kg_pbw", F.when(
            F.col("pbw_kg") > 0, F.col("tidal_volume_observed_final") / F.col("pbw_kg")))
    here = set(joined.columns) - {"stay_id", "subject_id", "charttime", "rejected", "_static"}
    missing, extra = sorted(set(assets.features) - here), sorted(here - set(assets.features))
    if missing or extra:
        raise ValueError(f"not the columns of the model: missing {missing}, unexpected {extra}")
    reasons = [F.when(F.col("_static").isNull(), F.lit("no static row"))]
    for column, levels in assets.levels.items():
        unseen = F.col(column).isNotNull() & ~F.coalesce(F.col(column).isin(*levels), F.lit(False))
        reasons.append(F.when(unseen, F.concat(F.lit(f"unknown {column}: "), F.col(column))))
    checked = joined.withColumn("rejected", F.coalesce("rejected", *reasons))
    accepted = F.col("rejected").isNull()
    return checked.select("stay_id", "charttime", "rejected",
                          *[F.when(accepted, F.col(c)).alias(c) for c in assets.features])
