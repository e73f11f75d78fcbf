"""Registered queries over heads: several scores of the same rows, compared on them.

`head_models` fits the heads on the feature matrix and its target. The other queries take stored
scores, one column per head, from `lineitem` (patient: supplier; label: returned); the oracle
restates the comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ventide.operators import heads
from ventide.plans import evaluation as EV
from ventide.plans.serving import Matrix
from ventide.plans.sources_sql import with_sources
from ventide.plans.timeseries import r
from ventide.session import materialize
from ventide.sources import testdata as TD

AGAINST = "platt"
# Stored scores. Some come without a value where a price or a discount is extreme: those rows are
# left out of every comparison.
SCORES = {
    "leaky": "round(l_extendedprice / (l_extendedprice + 40000), 4)",
    "weighted": "round(l_extendedprice / (l_extendedprice + 20000), 4)",
    "unweighted": "round(0.6 * l_extendedprice / (l_extendedprice + 50000), 4)",
    "platt": "round(0.5 * l_extendedprice / (l_extendedprice + 20000), 4)",
    "isotonic": "round(0.1 * floor(5 * l_extendedprice / (l_extendedprice + 20000)), 4)",
    "squared": "CASE WHEN l_extendedprice < 100000 THEN round(0.3 + l_extendedprice / 1000000, 4) END",
    "chain": "round(0.25 + l_tax / 2 + l_extendedprice / 2000000, 4)",
    "plain_chain": "round(0.2 + l_quantity / 200, 4)",
    "forest": "round(0.1 + l_quantity / 250 + l_discount, 4)",
    "forest_platt": "round(0.05 + l_quantity / 500 + l_discount / 2, 4)",
    "documentation": "CASE WHEN l_discount < 0.1 THEN round(0.2 + l_discount * 2 + l_tax, 4) END",
}


def stored(spark, sf) -> DataFrame:
    rows = TD.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS subject_id", "if(l_returnflag = 'R', 1, 0) AS y", *[f"{e} AS {n}" for n, e in SCORES.items()])
    return materialize(heads.frame(rows, heads.HEADS, "subject_id"))


def shown(table: DataFrame) -> DataFrame:
    return table.select("head", "rows", *[r(c, 6) for c in table.columns if c not in ("head", "rows")])


def q_metrics(spark, sf):
    return shown(heads.head_metrics(stored(spark, sf), heads.HEADS))


def q_differences(spark, sf):
    """The mapped score against every other head: four metrics on 200 resamples of whole patients."""
    found = heads.head_replicates(stored(spark, sf), heads.HEADS, "subject_id", EV.REPLICATES)
    return heads.head_differences(found, AGAINST).select(
        "head", "metric", r("mean", 6), r("lo", 6), r("hi", 6), "resamples", r("p_worse", 6))


def q_shares(spark, sf):
    table = materialize(heads.head_metrics(stored(spark, sf), heads.HEADS))
    out = heads.documentation_shares(table)
    return out.select(*[r(c, 6) for c in out.columns])


def q_models(spark, sf):
    """All heads fitted on the matrix and judged on the test patients."""
    m = Matrix(spark, sf)
    sets = m.manifest["sets"]
    categories = m.manifest["categorical"]
    numeric = [c for c in sets["full"] if c not in categories]
    fitted = materialize(heads.fit_heads(m.aligned, numeric, sets["documentation"], categories))
    return shown(heads.head_metrics(heads.frame(fitted, heads.HEADS, "subject_id"), heads.HEADS))


QUERIES = {
    "head_metrics": q_metrics,
    "head_differences": q_differences,
    "documentation_shares": q_shares,
    "head_models": q_models,
}

# ------------------------------------------------------------------ oracles
_ALL = " AND ".join(f"{n} IS NOT NULL" for n in SCORES)
_STORED = ("SELECT * FROM (SELECT l_suppkey AS subject_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, "
           + ", ".join(f"{e} AS {n}" for n, e in SCORES.items()) + f" FROM lineitem) WHERE {_ALL}")


def _rank(head: str) -> str:
    """Rank metrics of one head from its running counts."""
    return f"""SELECT '{head}' AS head, CAST(sum(n) AS BIGINT) AS rows, sum(pos) / sum(n) AS positive_rate,
      sum(pos * tp / seen) / sum(pos) AS ap,
      sum((n - pos) * (tp - pos / 2.0)) / (sum(pos) * sum(n - pos)) AS auc,
      sum(pos * (1 - p) ** 2 + (n - pos) * p ** 2) / sum(n) AS brier, sum(p * n) / sum(n) AS mean_predicted
      FROM (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS tp
            FROM (SELECT {head} AS p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY ALL)
            WINDOW w AS (ORDER BY p DESC))"""


_TABLE = {
    "scored": _STORED,
    "plain": " UNION ALL ".join(_rank(h) for h in SCORES),
    "judged": "SELECT *, 1 - brier / (positive_rate * (1 - positive_rate)) AS brier_skill FROM plain",
}
_ONE = "(SELECT {c} FROM judged WHERE head = '{h}')"


def _share(c: str, of: str, full: str, floor: str) -> str:
    return f"({_ONE.format(c=c, h=of)} - {floor}) / ({_ONE.format(c=c, h=full)} - {floor})"


def _differences() -> str:
    steps = {"scored": _STORED, "weights": EV._weights(EV.REPLICATES, "subject_id", "scored")}
    for head in SCORES:
        steps.update(EV._metric_reps(head))
    pairs = " UNION ALL ".join(
        f"SELECT '{h}' AS head, metric, CASE WHEN metric IN ('ap', 'auc') THEN a.v - b.v ELSE b.v - a.v END AS x"
        f" FROM l_{AGAINST} a JOIN l_{h} b USING (rep, metric)" for h in SCORES if h != AGAINST)
    return with_sources([], {**steps, "d": pairs},
                        f"SELECT head, metric, {EV._CI.format(v='x')}, round(avg(CASE WHEN x <= 0 THEN 1 ELSE 0 END), 6)"
                        " AS p_worse FROM d GROUP BY head, metric")


ORACLES = {
    "head_metrics": with_sources(
        [], _TABLE, "SELECT head, rows, " + ", ".join(
            f"round({c}, 6) AS {c}" for c in ("positive_rate", "ap", "auc", "brier", "brier_skill", "mean_predicted")) + " FROM judged"),
    "head_differences": _differences(),
    "documentation_shares": with_sources(
        [], _TABLE, f"SELECT round({_share('ap', 'documentation', 'weighted', '(SELECT max(positive_rate) FROM judged)')}, 6) AS ap_share,"
        f" round({_share('auc', 'documentation', 'weighted', '0.5')}, 6) AS auc_share,"
        f" round({_share('brier_skill', 'documentation', 'platt', '0')}, 6) AS brier_skill_share"),
}
