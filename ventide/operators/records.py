"""Nested risk records: score, band, telemetry with provenance, and attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventide import config as C
from ventide.operators.metrics import sigmoid


def clean_number(c: Column, digits: int = 4) -> Column:
    """JSON has no NaN: NaN becomes null, the rest is rounded half to even."""
    value = c.cast("double")
    return F.when(~F.isnan(value), F.bround(value, digits))


def telemetry() -> Column:
    """Per parameter: value, age, whether measured now, and whose value it is.

    A null carried value means the number in use is a population statistic.
    """
    entries = []
    for p in C.PARAMS:
        measured = F.col(f"{p}_observed") == 1
        source = (
            F.when(measured, "measured")
            .when(F.col(f"{p}_locf").isNull(), "population_reference")
            .otherwise("carried_forward")
        )
        entries += [
            F.lit(p),
            F.struct(
                clean_number(F.col(f"{p}_final")).alias("value"),
                clean_number(F.col(f"{p}_delta_t_min")).alias("age_min"),
                measured.alias("measured"),
                source.alias("source"),
            ),
        ]
    return F.create_map(*entries)


def ranked_places(features: Sequence[str], array: str = "contributions") -> Column:
    """Places of the features in the array, the largest contribution first (names break ties).

    Places are fixed, so the sort keys are plain columns and the array sorts in its natural order:
    nothing is called once a comparison.
    """
    keys = [
        F.struct((-F.abs(F.get(F.col(array), F.lit(i)))).alias("rank"), F.lit(f).alias("feature"), F.lit(i).alias("at"),
                 F.get(F.col(array), F.lit(i)).alias("contribution"))
        for i, f in enumerate(features)
    ]
    return F.sort_array(F.array(*keys))


def contributor(at: Column, contribution: Column, features: Sequence[str], kinds: dict[str, tuple[str, str]],
                values: Column) -> Column:
    """The feature at a place as a named contribution with its value as text."""
    return F.struct(
        F.get(F.array(*[F.lit(f) for f in features]), at).alias("feature"),
        F.get(values, at).cast("string").alias("value"),
        contribution.alias("contribution"),
        F.get(F.array(*[F.lit(kinds[f][0]) for f in features]), at).alias("kind"),
        F.get(F.array(*[F.lit(kinds[f][1]) for f in features]), at).alias("group"),
    )


def feature_values(df: DataFrame, features: Sequence[str]) -> Column:
    """The features as an array: of their own type if they share one, so that only values in use
    become text, else of texts."""
    types = dict(df.dtypes)
    shared = len({types[f] for f in features}) == 1
    return F.array(*[F.col(f) if shared else F.col(f).cast("string") for f in features])


def _total(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, c: acc + value(c))


def attribution_columns(ranked: Column, values: Column, features: Sequence[str],
                        kinds: dict[str, tuple[str, str]], k: int = C.CONTRIBUTOR_TOP_K,
                        array: str = "contributions") -> dict[str, Column]:
    """Top contributors, the signed tail, and three shares of one denominator.

    The documentation and the imputed share cover disjoint features, so they add up to at
    most one. The age is weighted by attribution, not the oldest value in use. Features have
    fixed places in the array, so sums are plain sums of their sizes.
    """
    place = {f: i for i, f in enumerate(features)}

    def size_of(names: Sequence[str]) -> Column:
        out = F.lit(0.0)
        for name in names:
            out = out + F.abs(F.get(F.col(array), place[name]))
        return out

    total = size_of(features)
    documentation = size_of([f for f in features if kinds[f][0] == "documentation"])
    imputed, aged, weighed = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for p in C.PARAMS:
        names = [f"{p}_final", f"{p}_locf"]
        if p == "tidal_volume_observed":
            names.append("tidal_volume_ml_per_kg_pbw")
        names = [f for f in features if f in names]
        if not names:
            continue
        weight = size_of(names)
        imputed = imputed + F.when(F.col(f"{p}_locf").isNull(), weight).otherwise(0.0)
        age = F.col(f"{p}_delta_t_min")
        aged = aged + F.when(age.isNotNull(), weight * age).otherwise(0.0)
        weighed = weighed + F.when(age.isNotNull(), weight).otherwise(0.0)
    first = [F.get(ranked, F.lit(i)) for i in range(min(k, len(features)))]
    tail = F.lit(0.0)
    for i in range(k, len(features)):
        tail = tail + F.get(ranked, F.lit(i))["contribution"]
    share = lambda part: F.round(F.when(total > 0, part / total).otherwise(0.0), 4)
    return {
        "contributors": F.array(*[
            contributor(s["at"], s["contribution"], features, kinds, values) for s in first]),
        "contributors_other": F.round(tail, 8),
        "contributors_bias": F.round(F.col("bias"), 8),
        "documentation_share": share(documentation),
        "imputed_share": share(imputed),
        "attribution_age_min": F.when(weighed > 0, F.round(aged / weighed, 4)),
        "attribution_total": F.round(total, 8),
    }


def build_records(df: DataFrame, features: Sequence[str], kinds: dict[str, tuple[str, str]],
                  band_meta: DataFrame, base_rate: float, provenance: dict[str, object]) -> DataFrame:
    """One nested record per reading.

    `df` carries the reading, its telemetry columns, p, the band view and contributions;
    `band_meta` has one row per band (displayed, observed_rate, lo, hi).
    """
    # As many rows as there are bands.
    joined = df.join(F.broadcast(band_meta), "displayed")
    ordered = joined.withColumns({"_ranked": ranked_places(features), "_values": feature_values(df, features)})
    return ordered.select(
        F.lit(C.RECORD_SCHEMA_VERSION).alias("schema_version"),
        F.struct(*[F.lit(v).alias(k) for k, v in provenance.items()]).alias("provenance"),
        "stay_id", "charttime",
        F.struct(F.col("p").alias("calibrated"), F.lit(True).alias("is_probability")).alias("risk"),
        F.struct(
            "displayed", "instant", F.col("band_state").alias("state"), "readings_in_state",
            "observed_rate", F.lit(base_rate).alias("base_rate"),
            F.round(F.col("observed_rate") / base_rate, 4).alias("lift"),
            F.array("lo", "hi").alias("envelope"),
        ).alias("band"),
        telemetry().alias("telemetry"),
        F.array(F.struct(F.lit("MODEL_BAND").alias("code"), F.col("displayed").alias("band")))
        .alias("reasons"),
        *[c.alias(n) for n, c in attribution_columns(
            F.col("_ranked"), F.col("_values"), features, kinds).items()],
    )


def reconstructs(tolerance: float = C.RECONSTRUCTION_TOLERANCE) -> Column:
    """Do contributors, tail and bias add up to the score the record reports?"""
    logit = (_total(F.col("contributors"), lambda c: c["contribution"])
             + F.col("contributors_other") + F.col("contributors_bias"))
    return F.abs(sigmoid(logit) - F.col("risk.calibrated")) < tolerance


def record_checks(records: DataFrame) -> DataFrame:
    """Contract of the record set as rows (check, violations)."""
    states = ("confirmed", "provisional", "demoting")
    sources = ("measured", "carried_forward", "population_reference")
    band = F.col("band")
    shares = F.col("documentation_share") + F.col("imputed_share")
    checks = {
        "band names known": band["displayed"].isin(*C.BAND_NAMES) & band["instant"].isin(*C.BAND_NAMES),
        "state known": band["state"].isin(*states),
        "confirmed iff equal": (band["state"] == "confirmed") == (band["displayed"] == band["instant"]),
        "readings in state positive": band["readings_in_state"] >= 1,
        "score is a probability": F.col("risk.calibrated").between(0.0, 1.0),
        "attribution reconstructs": reconstructs(),
        "shares disjoint": shares <= 1.0 + 1e-3,
        "sources known": F.forall(F.map_values("telemetry"), lambda t: t["source"].isin(*sources)),
        "measured has age zero": F.forall(
            F.map_values("telemetry"), lambda t: ~t["measured"] | (t["age_min"] == 0)),
        "contributors ranked": F.expr(
            "forall(sequence(2, size(contributors)), i -> abs(contributors[i - 2].contribution)"
            " >= abs(contributors[i - 1].contribution)) OR size(contributors) < 2"),
        "no NaN": F.forall(F.map_values("telemetry"),
                           lambda t: t["value"].isNull() | ~F.isnan(t["value"])),
    }
    counted = records.agg(*[
        F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()
    ])
    return counted.unpivot([], list(checks), "check", "violations")


def top_feature_counts(records: DataFrame) -> DataFrame:
    """How often each feature is the strongest contributor."""
    return records.groupBy(F.get("contributors", 0)["feature"].alias("feature")).agg(
        F.count(F.lit(1)).alias("readings"))
