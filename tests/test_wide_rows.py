"""Steps over wide rows: one pass a record, no call per comparison, no method the JVM will not compile."""

from pyspark.sql import functions as F
from test_text import record

from ventide.operators import assemble, comorbidity, explain
from ventide.session import materialize


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_outcome_follows_from_the_record_alone(spark):
    """F22 F23 F24: text is made without joining records to themselves."""
    rec = materialize(record(spark))
    out = explain.explanations(rec)
    assert "Join" not in plan(out)
    refused = explain.explanations(rec.withColumn("imputed_share", F.lit(0.9))).first()
    assert refused.status == explain.INSUFFICIENT and refused.generator is None
    assert out.first().generator == "template"


def test_contributors_are_ranked_by_place(spark):
    """F22 F23 F24: the sort has natural order, values keep their own text."""
    rec = record(spark)
    assert "array_sort" not in plan(rec) and "lambda" not in plan(rec.select("contributors", "contributors_other"))
    assert [(c.feature, c.value) for c in rec.first().contributors] == [
        ("spo2_final", "91.0"), ("peep_final", "6.0"), ("etco2_observed", "0"), ("fio2_final", "8.0")]


def test_wide_methods_stay_compilable(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_filled_counts(spark):
    """counts alone."""
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert {tuple(r) for r in assemble.filled_counts(df, ["a", "b"]).collect()} == {("a", 2), ("b", 1)}


def test_codes_stay_one_row(spark):
    """F26 F30: categories are bits; short, unknown and null codes keep their admission."""
    df = spark.createDataFrame(
        [(1, 10, " i21 "), (1, 10, "E112"), (2, 10, "I2"), (3, 9, None), (4, 9, "4100")],
        "hadm_id int, icd_version int, icd_code string")
    out = comorbidity.category_flags(df)
    assert "Generate" not in plan(out)
    total = sum(F.col(f"cci_{n}") for n in comorbidity.NAMES)
    found = {r.hadm_id: (r.cci_myocardial_infarction, r.cci_diabetes_complicated, r.t)
             for r in out.withColumn("t", total).collect()}
    assert found == {1: (1, 1, 2), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 0, 1)}
