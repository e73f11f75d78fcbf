"""Rank and level metrics of scores against 0/1 labels, exact and without a global sort.

`df` needs a label column y and a score column p. Ordered quantities come from
`cumulate`, which counts ties first and orders slices independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.functions.quantile import cumulate, quantiles
from ventide.functions.timefn import hour_bucket
from ventide.session import materialize


def logit(p: Column, eps: float = C.LOGIT_EPS) -> Column:
    inside = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(inside / (1.0 - inside))


def sigmoid(x: Column) -> Column:
    """Logistic function that cannot overflow."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p"))


def score_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    return _clean(df).groupBy(*by, "p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos")
    )


def rank_metrics(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, positive rate, average precision, ROC-AUC and Brier score, one row per group.

    Ties share one threshold. AP adds precision times recall gained from the top score
    down; AUC counts, per score, the negatives below plus half of those beside it.
    """
    counted = score_counts(df, by)
    running = cumulate(counted, by, "p", {"_n": "n", "_pos": "pos"}, descending=True)
    negatives = F.col("n") - F.col("pos")
    seen_negatives = F.col("_n") - F.col("_pos")
    brier = F.col("pos") * F.pow(1 - F.col("p"), 2) + negatives * F.pow(F.col("p"), 2)
    sums = running.groupBy(*by).agg(
        F.sum("n").alias("_rows"),
        F.sum("pos").alias("_positives"),
        F.sum(F.col("pos") * F.col("_pos") / F.col("_n")).alias("_ap"),
        F.sum(negatives * (F.col("_pos") - F.col("pos") / 2.0)).alias("_pairs"),
        F.sum(brier).alias("_brier"),
        F.max(seen_negatives).alias("_negatives"),
        F.sum(F.col("p") * F.col("n")).alias("_psum"),
    )
    n, pos, neg = F.col("_rows"), F.col("_positives"), F.col("_negatives")
    return sums.select(
        *by,
        n.alias("rows"),
        (pos / n).alias("positive_rate"),
        F.try_divide("_ap", pos).alias("ap"),
        F.try_divide(F.col("_pairs"), pos * neg.cast("double")).alias("auc"),
        (F.col("_brier") / n).alias("brier"),
        (F.col("_psum") / n).alias("mean_predicted"),
    )


def bin_edges(df: DataFrame, bins: int = C.RELIABILITY_BINS) -> DataFrame:
    """Inner equal-mass edges of the scores as one sorted array."""
    inner = [i / bins for i in range(1, bins)]
    found = quantiles(_clean(df), [], "p", inner)
    return found.agg(F.array_sort(F.collect_list("quantile")).alias("edges"))


def reliability(df: DataFrame, bins: int = C.RELIABILITY_BINS) -> DataFrame:
    """Predicted and observed rate per equal-mass bin. A score on an edge belongs above."""
    place = F.size(F.filter(F.col("_edges"), lambda e: e <= F.col("p")))
    return (
        score_counts(df)
        .withColumn("_edges", bin_edges(df, bins).scalar())
        .withColumn("bin", place)
        .groupBy("bin")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean_predicted"),
            (F.sum("pos") / F.sum("n")).alias("observed"),
        )
    )


def level_metrics(df: DataFrame, bins: int = C.RELIABILITY_BINS) -> DataFrame:
    """ECE, MCE, the three parts of the Brier score and skill over the base rate."""
    rows = reliability(df, bins)
    gap = F.abs(F.col("mean_predicted") - F.col("observed"))
    whole = materialize(rank_metrics(df).select("rows", "positive_rate", "brier"))
    base = whole.select("positive_rate").scalar()
    total = whole.select("rows").scalar()
    weight = F.col("n") / total
    parts = rows.select(
        (weight * gap).alias("_ece"), gap.alias("_gap"),
        (weight * F.pow(F.col("mean_predicted") - F.col("observed"), 2)).alias("_rel"),
        (weight * F.pow(F.col("observed") - base, 2)).alias("_res"),
    ).agg(
        F.sum("_ece").alias("ece"), F.max("_gap").alias("mce"),
        F.sum("_rel").alias("reliability"), F.sum("_res").alias("resolution"),
    )
    uncertainty = base * (1 - base)
    return parts.select(
        "ece", "mce", "reliability", "resolution",
        uncertainty.alias("uncertainty"),
        (1 - whole.select("brier").scalar() / uncertainty).alias("brier_skill"),
    )


def operating_points(df: DataFrame, thresholds: DataFrame, stay: str = "stay_id",
                     time: str = "charttime") -> DataFrame:
    """Sensitivity, precision and alert hours per 24 monitored hours for each threshold.

    Counts per threshold come from distinct scores and from the highest score of every
    (stay, clock hour): an hour alerts iff its highest score is above the threshold. Both
    are running totals looked up at the threshold, so rows are never paired with thresholds.
    """
    clean = _clean(df)
    scores = materialize(score_counts(clean))
    hours = materialize(
        clean.groupBy(stay, hour_bucket(F.col(time)).alias("_hour"))
        .agg(F.max("p").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("hours"))
    )
    marks = thresholds.select(F.col("threshold").alias("p")).distinct()
    entries = (
        scores.unionByName(hours, allowMissingColumns=True)
        .unionByName(marks.withColumn("mark", F.lit(1)), allowMissingColumns=True)
        .groupBy("p")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "pos", "hours", "mark")])
    )
    running = cumulate(entries, [], "p", {"_n": "n", "_pos": "pos", "_hours": "hours"})
    totals = scores.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    n_all, pos_all = totals.select("n").scalar(), totals.select("pos").scalar()
    hours_all = hours.agg(F.sum("hours")).scalar()
    flagged, hit = n_all - F.col("_n"), pos_all - F.col("_pos")
    return running.where(F.col("mark") > 0).select(
        F.col("p").alias("threshold"),
        (100.0 * flagged / n_all).alias("rows_flagged_pct"),
        (hit / F.greatest(pos_all, F.lit(1))).alias("sensitivity"),
        (hit / F.greatest(flagged, F.lit(1))).alias("ppv"),
        (hours_all - F.col("_hours")).alias("alert_hours"),
        (24.0 * (hours_all - F.col("_hours")) / F.greatest(hours_all, F.lit(1)))
        .alias("alerts_per_24h"),
    )


def budget_grid(df: DataFrame, points: int = C.BUDGET_GRID_POINTS) -> DataFrame:
    """Candidate thresholds: evenly spaced quantiles of the score."""
    steps = [i / (points - 1) for i in range(points)]
    return quantiles(_clean(df), [], "p", steps).select(F.col("quantile").alias("threshold"))


def thresholds_for_budgets(df: DataFrame, budgets: tuple[float, ...] = C.ALERT_BUDGETS,
                           points: int = C.BUDGET_GRID_POINTS, stay: str = "stay_id",
                           time: str = "charttime") -> DataFrame:
    """Lowest grid threshold that fits each budget; the highest where none does.

    The alert rate falls as the threshold rises, so the lowest fit is the first one.
    """
    table = operating_points(df, budget_grid(df, points), stay, time)
    row = F.struct(*[F.col(c) for c in table.columns])
    picks = []
    for i, budget in enumerate(budgets):
        fits = F.col("alerts_per_24h") <= budget
        picks += [
            F.min_by(row, F.when(fits, F.col("threshold"))).alias(f"fit{i}"),
        ]
    best = table.agg(*picks, F.max_by(row, "threshold").alias("top"))
    return best.select(
        F.inline(
            F.array(*[
                F.struct(F.lit(float(b)).alias("budget"),
                         F.col(f"fit{i}").isNotNull().alias("reachable"),
                         F.coalesce(f"fit{i}", "top").alias("at"))
                for i, b in enumerate(budgets)
            ])
        )
    ).select("budget", "reachable", "at.*")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """2x2 counts, Cohen's kappa and Jaccard overlap of two 0/1 columns."""
    x, y = F.col(a) == 1, F.col(b) == 1
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"),
        F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"),
    )
    n = (F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither")).cast("double")
    agree = (F.col("both") + F.col("neither")) / n
    pa = (F.col("both") + F.col("only_a")) / n
    pb = (F.col("both") + F.col("only_b")) / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return c.select(
        "*",
        F.try_divide(agree - chance, 1 - chance).alias("kappa"),
        F.try_divide(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b"))
        .alias("jaccard"),
    )


def coverage(df: DataFrame, stay: str = "stay_id", time: str = "charttime") -> DataFrame:
    """Stays with any positive, monitored days and positives per monitored day."""
    per_hour = df.where(F.col("y").isNotNull()).groupBy(
        stay, hour_bucket(F.col(time)).alias("_hour")
    ).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per_stay = per_hour.groupBy(stay).agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("hours")
    )
    days = F.sum("hours") / 24.0
    return per_stay.agg(
        F.count(F.lit(1)).alias("stays"),
        F.count_if(F.col("pos") > 0).alias("stays_with_positive"),
        F.sum("n").alias("rows"), F.sum("pos").alias("positives"),
        days.alias("monitored_days"), F.try_divide(F.sum("pos"), days).alias("positives_per_day"),
    )


def documentation_share(full: float, doc_only: float, floor: float) -> float | None:
    """Part of a metric's gain over its floor that documentation columns alone reach."""
    return None if full == floor else (doc_only - floor) / (full - floor)


def gate_verdict(difference: dict, doc_share_before: float, doc_share_after: float,
                 tolerance: float = 0.01) -> dict:
    """Accept a change unless its metric falls beyond the interval or its documentation share
    grows by more than the tolerance."""
    worse = difference["hi"] < 0
    leaning = doc_share_after - doc_share_before > tolerance
    reasons = [r for r, bad in (("metric below baseline", worse),
                                ("documentation share grew", leaning)) if bad]
    return {"accepted": not reasons, "reasons": reasons}
