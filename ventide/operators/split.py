"""Patient-level split and folds, and seeded samples of whole groups.

Draws are hash orders of the identifiers: the same rows are drawn on any cluster, in any
order of execution. Ranks are taken per stratum over patients, not readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.quantile import cumulate
from ventide.session import materialize

BINS = 1 << 16  # of the draws of a class


def draw(seed: int, *ids: str) -> Column:
    """A reproducible pseudo-random text per identifier."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def draw_fraction(seed: int, *ids: str) -> Column:
    """The same draw as a number in [0, 1)."""
    head = F.conv(F.substring(draw(seed, *ids), 1, 12), 16, 10).cast("double")
    return head / F.lit(float(16**12))


def patient_summary(wide: DataFrame) -> DataFrame:
    return wide.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("warning").cast("long")).alias("n_pos"),
        F.countDistinct("stay_id").alias("n_stays"),
    )


def stratum(rate: Column) -> Column:
    return sum(
        (F.when(rate >= edge, 1).otherwise(0) for edge in C.STRATA_EDGES[1:]),
        F.when(rate >= C.STRATA_EDGES[0], 1).otherwise(0),
    )


def patient_split(wide: DataFrame, seed: int = C.SEED) -> DataFrame:
    """20% of the patients of each positive-rate stratum to test, five folds in the rest.

    A patient's place in its stratum is a running count over hash-ordered patients; strata
    are sliced, so a stratum with nearly all patients is not ordered in one task.
    """
    people = materialize(patient_summary(wide).withColumn(
        "strat", stratum(F.col("n_pos") / F.col("n_rows"))
    ))
    return place(people, seed)


def place(people: DataFrame, seed: int = C.SEED) -> DataFrame:
    ranked = cumulate(
        people.withColumn("_u", draw_fraction(seed, "subject_id")).withColumn("_n", F.lit(1)),
        ["strat"], "_u", {"_rank": "_n"}, tie=["subject_id"],
    )
    sizes = people.groupBy("strat").agg(F.count(F.lit(1)).alias("_size"))
    test_n = F.ceil(F.col("_size") * C.TEST_FRACTION)
    joined = ranked.join(sizes, "strat")
    is_test = F.col("_rank") <= test_n
    return joined.select(
        "subject_id", "n_rows", "n_pos", "n_stays", "strat",
        F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(is_test, -1).otherwise((F.col("_rank") - test_n - 1) % C.N_FOLDS)
        .cast("int").alias("fold"),
    )


def require_disjoint(split: DataFrame) -> None:
    train = split.where(F.col("split") == "train").select("subject_id")
    test = split.where(F.col("split") == "test").select("subject_id")
    shared = train.join(test, "subject_id", "left_semi").limit(1).count()
    if shared:
        raise AssertionError("a patient is on both sides of the split")


def sample_groups(df: DataFrame, key: str, n: int, seed: int = C.SEED) -> DataFrame:
    """All rows of n groups. The drawn keys are a top-n, the rows a semi join."""
    chosen = df.select(key).distinct().orderBy(draw(seed, key), key).limit(n)
    return df.join(chosen, key, "left_semi")


def sample_per_class(df: DataFrame, by: str, key: str, ids: list[str], n: int,
                     seed: int = C.SEED) -> DataFrame:
    """Up to n rows per class and at most one per (class, key), hash-ordered.

    The one row per key is an aggregate; the top n is filtered before the shuffle by
    Spark's window-group limit.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    single = (
        df.groupBy(by, key)
        .agg(F.min_by(row, F.struct(draw(seed, *ids), *ids)).alias("_row"))
        .select("_row.*")
    )
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw(seed, *ids), *ids))
    return single.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def balanced_sample(df: DataFrame, label: str, ids: list[str], total: int | None = None,
                    seed: int = C.SEED) -> DataFrame:
    """As many positives as negatives, at most `total` rows, in hash order.

    Draws are counted in BINS equal bins per class. Whole bins are taken up to the one that holds the
    class's last row; only that bin's draws are put in order, so no class is sorted or moved.
    """
    keyed = df.where(F.col(label).isNotNull()).withColumn("_u", draw_fraction(seed, *ids))
    keyed = keyed.withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    bins = materialize(keyed.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n")))
    sizes = {r[label]: r["n"] for r in bins.groupBy(label).agg(F.sum("_n").alias("n")).collect()}
    take = min(sizes.get(0, 0), sizes.get(1, 0))
    if total is not None:
        take = min(take, total // 2)
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    # The first bin that does not fit as a whole; none if the class is taken whole.
    split_bin = bins.withColumn("_upto", upto).where(F.col("_upto") > take).groupBy(label).agg(
        F.min("_bin").alias("_edge"), F.min_by(F.col("_upto") - F.col("_n"), "_bin").alias("_before"))
    split_bin = materialize(split_bin.withColumnRenamed(label, "_class"))
    edge = keyed.join(F.broadcast(split_bin), (F.col(label) == F.col("_class")) & (F.col("_bin") == F.col("_edge")))
    drawn = edge.groupBy("_class", "_edge", "_before", "_u").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.sum("_n").over(Window.partitionBy("_class").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0))
    ends = drawn.withColumn("_rank", rank + F.col("_before")).groupBy("_class", "_edge").agg(
        F.max(F.when(F.col("_rank") <= take, F.col("_u"))).alias("_last"))
    # One row a class, and what a class has up to its last drawn row is taken.
    ends = materialize(ends)
    fits = F.col("_class").isNull() | (F.col("_bin") < F.col("_edge")) | F.coalesce(F.col("_u") <= F.col("_last"), F.lit(False))
    joined = keyed.join(F.broadcast(ends), F.col(label) == F.col("_class"), "left")
    return joined.where(fits).select(*df.columns)


def stay_weights(readings: DataFrame) -> DataFrame:
    """1 / rows of the stay, scaled to mean 1: sum of weights = rows, so w = N / (S * n)."""
    sizes = readings.groupBy("stay_id").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_stays"))
    weights = sizes.select(
        "stay_id",
        (total.select("_rows").scalar()
         / (total.select("_stays").scalar() * F.col("_n"))).alias("weight"),
    )
    return readings.join(weights, "stay_id")
