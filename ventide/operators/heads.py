"""Heads: ways to turn the same features into a risk, judged side by side on the same rows.

A frame holds one row per reading with the scores of all heads as one aligned array, so that every
head is judged on the rows that all of them scored. The heads answer one question each:

leaky           what the tree count gains when the test rows decide it
weighted        boosted trees with positives weighted up: ranks well, levels are far too high
unweighted      the same without weights: is the weighting the cause
platt, isotonic the weighted score mapped to levels on a fold of its own
squared         a regression on the 0/1 label, which minimises the Brier score
chain           a regression on the mapped score: does one more step help
plain_chain     classifier, logistic fit and regression on the same rows, nothing held back
forest, forest_platt   another learner, raw and mapped
documentation   the weighted head on what was charted when, without any value

Differences are paired: both heads see the same resampled patients.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators import bootstrap, metrics, models
from ventide.session import materialize

HEADS = ("leaky", "weighted", "unweighted", "platt", "isotonic", "squared", "chain", "plain_chain", "forest",
         "forest_platt", "documentation")
STOP_FOLD, MAP_FOLD = 3, 4
_ML = ("rawPrediction", "probability", "prediction")


# ------------------------------------------------------------ fitting
def _inside(c: str):
    return F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))


def fit_heads(df: DataFrame, numeric: Sequence[str], documentation: Sequence[str], categorical: Sequence[str] = (),
              keys: Sequence[str] = ("subject_id", "stay_id", "charttime"), **params) -> DataFrame:
    """The test rows with `keys`, y and one column per head.

    `df` has the features, y, split and fold. Folds 0 to 2 fit, STOP_FOLD decides tree counts, MAP_FOLD
    fits the maps. Rows without y are left out; missing features become a sentinel.
    """
    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": C.SEED, "maxBins": 64, **params}
    every = list(dict.fromkeys([*numeric, *documentation]))
    base = models.filled(df.where("y IS NOT NULL"), every, categorical).withColumn("y", F.col("y").cast("double"))
    shape = models.feature_stages(numeric, categorical).fit(base.where("split = 'train'"))
    charted = VectorAssembler(inputCols=list(documentation), outputCol="charted")
    rows = materialize(charted.transform(shape.transform(base)).select(*keys, "y", "split", "fold", "features", "charted"))
    weight = models.class_weight(rows.where("split = 'train'"))
    train, test = F.col("split") == "train", F.col("split") == "test"
    fitting = rows.where(train & (F.col("fold") != MAP_FOLD)).withColumn("_stop", F.col("fold") == STOP_FOLD)

    def classifier(on: DataFrame, name: str, positive: float, features: str = "features") -> Callable[[DataFrame], DataFrame]:
        fitted = GBTClassifier(labelCol="y", featuresCol=features, weightCol="_w", validationIndicatorCol="_stop", **settings).fit(
            on.withColumn("_w", F.when(F.col("y") == 1, positive).otherwise(1.0)))
        return lambda to: fitted.transform(to).withColumn(name, vector_to_array("probability")[1]).drop(*_ML)

    def regression(on: DataFrame, target: str, name: str, stop: bool = True) -> Callable[[DataFrame], DataFrame]:
        learner = GBTRegressor(labelCol=target, featuresCol="features", **settings)
        fitted = (learner.setValidationIndicatorCol("_stop") if stop else learner).fit(on)
        return lambda to: fitted.transform(to).withColumn(name, _inside("prediction")).drop("prediction")

    def platt(held: DataFrame, score: str, name: str) -> Callable[[DataFrame], DataFrame]:
        slope, intercept = models.fit_platt(held.select("y", F.col(score).alias("p")))
        return lambda to: to.withColumn(name, models.apply_platt(F.col(score), slope, intercept))

    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=settings["maxIter"],
                                    maxDepth=settings["maxDepth"], maxBins=settings["maxBins"], seed=C.SEED).fit(fitting)
    scored = forest.transform(rows).withColumn("forest", vector_to_array("probability")[1]).drop(*_ML)
    for learned in (
        classifier(rows.withColumn("_stop", test), "leaky", weight),
        classifier(fitting, "weighted", weight),
        classifier(fitting, "unweighted", 1.0),
        classifier(fitting, "documentation", weight, "charted"),
        regression(fitting, "y", "squared"),
    ):
        scored = learned(scored)
    scored = materialize(scored)
    held = scored.where(train & (F.col("fold") == MAP_FOLD))
    for mapped in (platt(held, "weighted", "platt"), platt(held, "forest", "forest_platt")):
        scored = mapped(scored)
    steps = models.fit_isotonic(held.select("y", F.col("weighted").alias("p")))
    scored = steps.transform(scored.withColumn("p", F.col("weighted"))).withColumnRenamed("prediction", "isotonic").drop("p")
    one = VectorAssembler(inputCols=["unweighted"], outputCol="_one")
    logistic = LogisticRegression(labelCol="y", featuresCol="_one", maxIter=500).fit(
        one.transform(scored.where(train & (F.col("fold") != MAP_FOLD)).select("y", "unweighted")))
    scored = logistic.transform(one.transform(scored)).withColumn("_plain", vector_to_array("probability")[1]).drop(*_ML, "_one")
    scored = materialize(scored)
    again = scored.where(train & (F.col("fold") != MAP_FOLD)).withColumn("_stop", F.col("fold") == STOP_FOLD)
    out = scored.where(test)
    for learned in (regression(again, "platt", "chain"), regression(again, "_plain", "plain_chain", stop=False)):
        out = learned(out)
    return out.select(*keys, "y", *HEADS)


# ------------------------------------------------------------ judging
def frame(df: DataFrame, names: Sequence[str], cluster: str) -> DataFrame:
    """Cluster, y and the aligned scores of the rows on which the label and every head are known."""
    known = [F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) for n in names]
    rows = df.where(F.col("y").isNotNull())
    for k in known:
        rows = rows.where(k)
    return rows.select(cluster, F.col("y").cast("double").alias("y"),
                       F.array(*[F.col(n).cast("double") for n in names]).alias("scores"))


def head_metrics(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank metrics, Brier skill over the base rate and mean prediction, one row per head.

    Scores are counted per head and value in each task first; only distinct values are shuffled.
    """
    long = rows.select("y", F.posexplode("scores").alias("_i", "p"))
    labels = F.array(*[F.lit(n) for n in names])
    out = metrics.rank_metrics(long, ("_i",))
    base = F.col("positive_rate") * (1 - F.col("positive_rate"))
    return out.select(
        F.get(labels, F.col("_i")).alias("head"), "rows", "positive_rate", "ap", "auc", "brier",
        (1 - F.try_divide(F.col("brier"), base)).alias("brier_skill"), "mean_predicted")


def head_replicates(rows: DataFrame, names: Sequence[str], cluster: str, n: int = 200, seed: int = C.SEED) -> DataFrame:
    """head, rep, metric, value: all heads on the same resampled patients, one ordered pass a head."""
    out, drawn = None, materialize(bootstrap.weights(rows, cluster, n, seed))
    for i, name in enumerate(names):
        one = rows.select(cluster, "y", F.col("scores")[i].alias("p"))
        found = bootstrap.ordered_metrics(one, "p", cluster, n, seed, drawn=drawn).unpivot(["rep"], list(bootstrap.METRICS), "metric", "value")
        found = found.select(F.lit(name).alias("head"), "rep", "metric", "value")
        out = found if out is None else out.unionByName(found)
    return materialize(out)


def head_differences(replicates: DataFrame, against: str) -> DataFrame:
    """Interval of `against` minus every other head, per metric; losses are turned round, so p_worse is always
    the share of resamples in which `against` is not better. A resample in which either head has no value is left out."""
    left = replicates.where(F.col("head") == against).select("rep", "metric", F.col("value").alias("_a"))
    gain = F.col("_a") - F.col("value")
    signed = F.when(F.col("metric").isin([m for m, more in bootstrap.METRICS.items() if more]), gain).otherwise(-gain)
    pairs = replicates.where(F.col("head") != against).join(left, ["rep", "metric"])
    return bootstrap.interval(pairs.select("head", "metric", signed.alias("diff")), "diff", ("head", "metric"))


def documentation_shares(table: DataFrame, full: str = "weighted", documentation: str = "documentation",
                         mapped: str = "platt") -> DataFrame:
    """How much of the skill of `full` the documentation alone reaches, each metric over its own floor:
    the positive rate for AP, one half for AUC, the constant forecast for the Brier score (against `mapped`).
    Null where `full` has no skill."""
    of = lambda head, c: F.max(F.when(F.col("head") == head, F.col(c)))
    floor = F.max("positive_rate")
    return table.agg(
        F.try_divide(of(documentation, "ap") - floor, of(full, "ap") - floor).alias("ap_share"),
        F.try_divide(of(documentation, "auc") - 0.5, of(full, "auc") - 0.5).alias("auc_share"),
        F.try_divide(of(documentation, "brier_skill"), of(mapped, "brier_skill")).alias("brier_skill_share"))
