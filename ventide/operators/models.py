"""Risk model, calibration, baselines and attribution on Spark ML."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators import metrics, split

MISSING = -1.0


def feature_stages(numeric: Sequence[str], categorical: Sequence[str] = ()) -> Pipeline:
    """Indexed categories and numbers in one vector. Unseen levels get their own index."""
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep") for c in categorical
    ]
    inputs = [*numeric, *[f"_i_{c}" for c in categorical]]
    return Pipeline(stages=[*indexers, VectorAssembler(inputCols=inputs, outputCol="features")])


def filled(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Trees need a value: missing numbers become a sentinel below every range."""
    return df.withColumns({
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in numeric},
        **{c: F.coalesce(c, F.lit("(none)")) for c in categorical},
    })


def class_weight(df: DataFrame) -> float:
    """Negatives per positive."""
    n = df.agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos"))
    row = n.first()
    return row["neg"] / max(row["pos"], 1)


def fit_gbt(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
            stop_fold: int | None = 3, train_folds: Sequence[int] = (0, 1, 2),
            weight: float | None = None, **params) -> PipelineModel:
    """Gradient-boosted trees on the training folds; one fold decides the tree count."""
    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": C.SEED, "maxBins": 64,
                **params}
    used = [*train_folds, *([] if stop_fold is None else [stop_fold])]
    rows = filled(df.where(F.col("fold").isin(*used)), numeric, categorical)
    rows = rows.withColumn("_stop", F.col("fold") == (stop_fold if stop_fold is not None else -9))
    gbt = GBTClassifier(labelCol="y", featuresCol="features", **settings)
    if stop_fold is not None:
        gbt = gbt.setValidationIndicatorCol("_stop")
    if weight is not None:
        rows = rows.withColumn("_w", F.when(F.col("y") == 1, weight).otherwise(1.0))
        gbt = gbt.setWeightCol("_w")
    stages = feature_stages(numeric, categorical).getStages()
    return Pipeline(stages=[*stages, gbt]).fit(rows)


def score(model: PipelineModel, df: DataFrame, numeric: Sequence[str],
          categorical: Sequence[str] = ()) -> DataFrame:
    """Adds p, the raw probability."""
    scored = model.transform(filled(df, numeric, categorical))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction"
    )


# ------------------------------------------------------------ calibration
def fit_platt(df: DataFrame) -> tuple[float, float]:
    """Slope and intercept of an unregularised logistic fit on the logit of p."""
    rows = df.select("y", metrics.logit(F.col("p")).alias("x"))
    assembled = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    fit = LogisticRegression(labelCol="y", regParam=0.0, standardization=False,
                             maxIter=1000, tol=1e-10).fit(assembled)
    return float(fit.coefficients[0]), float(fit.intercept)


def apply_platt(p: Column, slope: float, intercept: float) -> Column:
    return metrics.sigmoid(slope * metrics.logit(p) + intercept)


def fit_isotonic(df: DataFrame):
    """Monotone step calibration; scores outside the fitted range take the edge value."""
    counted = metrics.score_counts(df).select(
        (F.col("pos") / F.col("n")).alias("y"), "p", F.col("n").cast("double").alias("w")
    )
    return IsotonicRegression(labelCol="y", featuresCol="p", weightCol="w").fit(counted)


def calibration_report(fitted_on: DataFrame, df: DataFrame) -> DataFrame:
    """Rank and level metrics of a score before and after each calibration map.

    The maps are fitted on rows the model has not seen and judged on others still.
    """
    slope, intercept = fit_platt(fitted_on)
    isotonic = fit_isotonic(fitted_on)
    variants = {
        "raw": df,
        "platt": df.withColumn("p", apply_platt(F.col("p"), slope, intercept)),
        "isotonic": isotonic.transform(df).drop("p").withColumnRenamed("prediction", "p"),
    }
    out = None
    for name, variant in variants.items():
        row = metrics.rank_metrics(variant.select("y", "p")).select(
            F.lit(name).alias("map"), "rows", "ap", "auc", "brier", "mean_predicted",
            "positive_rate")
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------ tuning and comparisons
def grouped_cv(df: DataFrame, numeric: Sequence[str], grid: Sequence[dict],
               folds: Sequence[int] = (0, 1, 2)) -> list[dict]:
    """Average precision of each setting over patient-grouped folds."""
    results = []
    for params in grid:
        for fold in folds:
            train = [f for f in folds if f != fold]
            model = fit_gbt(df, numeric, stop_fold=None, train_folds=train, **params)
            held = score(model, df.where(F.col("fold") == fold), numeric)
            ap = metrics.rank_metrics(held.select("y", "p")).first()["ap"]
            results.append({"params": str(sorted(params.items())), "fold": fold, "ap": ap})
    return results


def ablation(df: DataFrame, sets: dict[str, Sequence[str]], fold: int = 0, **params) -> list[dict]:
    """One model per named feature set, all judged on the same held-out fold."""
    others = [f for f in range(C.N_FOLDS) if f != fold]
    results = []
    for name, columns in sets.items():
        model = fit_gbt(df, columns, stop_fold=None, train_folds=others, **params)
        held = score(model, df.where(F.col("fold") == fold), columns)
        row = metrics.rank_metrics(held.select("y", "p")).first()
        results.append({"feature_set": name, "columns": len(columns), "rows": row["rows"],
                        "ap": row["ap"], "auc": row["auc"]})
    return results


def legacy_chain(train: DataFrame, test: DataFrame, numeric: Sequence[str], ids: Sequence[str],
                 max_rows: int | None = None, trees: int = 20) -> DataFrame:
    """The earlier method: balanced sample, two principal components, scaled; boosted
    classifier, logistic fit on its class-0 probability, boosted regression on the result.
    The class-0 column runs backwards; the final score is flipped."""
    sample = split.balanced_sample(filled(train, numeric), "y", list(ids), max_rows)
    reduce = Pipeline(stages=[
        VectorAssembler(inputCols=list(numeric), outputCol="_x"),
        PCA(k=2, inputCol="_x", outputCol="_z"),
        StandardScaler(inputCol="_z", outputCol="features", withMean=True, withStd=True),
    ]).fit(sample)
    settings = {"maxIter": trees, "maxDepth": 4, "stepSize": 0.1, "seed": C.SEED,
                "minInstancesPerNode": 5}
    classifier = GBTClassifier(labelCol="y", **settings).fit(reduce.transform(sample))
    keep = ["y", "features", "_p0"]

    def class_zero(df: DataFrame) -> DataFrame:
        out = classifier.transform(reduce.transform(df))
        return out.withColumn("_p0", vector_to_array("probability")[0]).select(*keep)

    assembler = VectorAssembler(inputCols=["_p0"], outputCol="_v")
    staged = assembler.transform(class_zero(sample))
    logistic = LogisticRegression(labelCol="y", featuresCol="_v", maxIter=500, regParam=1e-3,
                                  probabilityCol="_c").fit(staged)
    calibrated = logistic.transform(staged).select(
        "features", vector_to_array("_c")[0].alias("target"))
    regression = GBTRegressor(labelCol="target", **settings).fit(calibrated)
    scored = regression.transform(reduce.transform(filled(test, numeric)))
    clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select("y", (1.0 - clipped).alias("p"))


def importance_by_group(model: PipelineModel, names: Sequence[str],
                        groups: dict[str, str]) -> list[dict]:
    """Share of total importance per source group, and per feature."""
    weights = model.stages[-1].featureImportances.toArray()
    total = float(weights.sum()) or 1.0
    return [
        {"feature": n, "source": groups.get(n, "unknown"), "share": float(w) / total}
        for n, w in zip(names, weights, strict=True)
    ]


# ------------------------------------------------------------ attribution
def _leaves(node, weight: float, path: tuple) -> Iterator[tuple]:
    """(value, ((feature, is_left, threshold, share of rows), ...)) per leaf."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        yield node.prediction() * weight, path
        return
    cut = node.split()
    feature, threshold = cut.featureIndex(), cut.threshold()
    here = node.impurityStats().count()
    for is_left, child in ((True, node.leftChild()), (False, node.rightChild())):
        share = child.impurityStats().count() / here if here else 0.0
        yield from _leaves(child, weight, (*path, (feature, is_left, threshold, share)))


def export_leaves(model: PipelineModel) -> list[tuple]:
    """All leaves of a boosted model, scaled to the log-odds of its probability."""
    boosted = model.stages[-1]
    out = []
    for tree, weight in zip(boosted.trees, boosted.treeWeights, strict=True):
        out += list(_leaves(tree._call_java("rootNode"), 2.0 * float(weight), ()))
    return out


def _orderings(d: int) -> list[float]:
    return [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]


def shapley(leaves: list[tuple], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values of a sum of trees for a block of rows.

    A leaf is a product game: a feature in the coalition contributes whether the row meets
    its conditions on the path, one outside it the share of training rows that did.
    """
    values = np.zeros(x.shape)
    bias = 0.0
    for value, path in leaves:
        met: dict[int, np.ndarray] = {}
        share: dict[int, float] = {}
        for feature, is_left, threshold, part in path:
            ok = x[:, feature] <= threshold
            ok = ok if is_left else ~ok
            met[feature] = met[feature] & ok if feature in met else ok
            share[feature] = share.get(feature, 1.0) * part
        bias += value * float(np.prod(list(share.values()))) if share else value
        features = list(met)
        weights = _orderings(len(features)) if features else []
        for i in features:
            others = [j for j in features if j != i]
            total = np.zeros(len(x))
            for size in range(len(others) + 1):
                for inside in itertools.combinations(others, size):
                    term = np.full(len(x), weights[size])
                    for j in others:
                        term = term * (met[j] if j in inside else share[j])
                    total += term
            values[:, i] += value * (met[i].astype(float) - share[i]) * total
    return values, bias


def attribute(model: PipelineModel, scored: DataFrame, slope: float = 1.0,
              intercept: float = 0.0) -> DataFrame:
    """Adds `contributions` (one per feature) and `bias` in calibrated log-odds:
    their sum is slope * logit(p) + intercept."""
    leaves = scored.sparkSession.sparkContext.broadcast(export_leaves(model))

    @F.pandas_udf("struct<contributions:array<double>,bias:double>")
    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            block = np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, 0))
            values, bias = shapley(leaves.value, block)
            yield pd.DataFrame({
                "contributions": list(values * slope),
                "bias": np.full(len(rows), bias * slope + intercept),
            })

    return scored.withColumn("_a", explain(vector_to_array("features"))).select(
        *scored.columns, "_a.contributions", "_a.bias"
    )
