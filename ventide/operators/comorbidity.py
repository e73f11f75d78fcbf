"""Charlson comorbidity categories from ICD codes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (Quan et al. 2005, enhanced coding): category, weight, ICD-9 prefixes, ICD-10
# prefixes. A range such as 430-438 or I60-I69 stands for every prefix in it.
CATEGORIES: tuple[tuple[str, int, str, str], ...] = (
    ("myocardial_infarction", 1, "410 412", "I21 I22 I252"),
    ("congestive_heart_failure", 1,
     "39891 40201 40211 40291 40401 40403 40411 40413 40491 40493 4254-4259 428",
     "I099 I110 I130 I132 I255 I420 I425-I429 I43 I50 P290"),
    ("peripheral_vascular", 1,
     "0930 4373 440 441 4431-4439 4471 5571 5579 V434",
     "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959"),
    ("cerebrovascular", 1, "36234 430-438", "G45 G46 H340 I60-I69"),
    ("dementia", 1, "290 2941 3312", "F00-F03 F051 G30 G311"),
    ("chronic_pulmonary", 1,
     "4168 4169 490-505 5064 5081 5088",
     "I278 I279 J40-J47 J60-J67 J684 J701 J703"),
    ("rheumatic", 1,
     "4465 7100-7104 7140-7142 7148 725",
     "M05 M06 M315 M32-M34 M351 M353 M360"),
    ("peptic_ulcer", 1, "531-534", "K25-K28"),
    ("mild_liver_disease", 1,
     "07022 07023 07032 07033 07044 07054 0706 0709 570 571 5733 5734 5738 5739 V427",
     "B18 K700-K703 K709 K713-K715 K717 K73 K74 K760 K762-K764 K768 K769 Z944"),
    ("diabetes_uncomplicated", 1,
     "2500-2503 2508 2509",
     "E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129"
     " E130 E131 E136 E138 E139 E140 E141 E146 E148 E149"),
    ("diabetes_complicated", 2,
     "2504-2507",
     "E102-E105 E107 E112-E115 E117 E122-E125 E127 E132-E135 E137 E142-E145 E147"),
    ("paraplegia_hemiplegia", 2,
     "3341 342 343 3440-3446 3449",
     "G041 G114 G801 G802 G81 G82 G830-G834 G839"),
    ("renal_disease", 2,
     "40301 40311 40391 40402 40403 40412 40413 40492 40493 582 5830-5837 585 586 5880"
     " V420 V451 V56",
     "I120 I131 N032-N037 N052-N057 N18 N19 N250 Z490-Z492 Z940 Z992"),
    ("malignancy", 2,
     "140-172 174-195 200-208 2386",
     "C00-C26 C30-C34 C37-C41 C43 C45-C58 C60-C76 C81-C85 C88 C90-C97"),
    ("severe_liver_disease", 3,
     "4560-4562 5722-5728",
     "I850 I859 I864 I982 K704 K711 K721 K729 K765-K767"),
    ("metastatic_tumor", 6, "196-199", "C77-C80"),
    ("aids_hiv", 6, "042-044", "B20-B22 B24"),
)

# The milder member of a pair scores nothing beside the severer one.
GRADED = {
    "mild_liver_disease": "severe_liver_disease",
    "diabetes_uncomplicated": "diabetes_complicated",
    "malignancy": "metastatic_tumor",
}
# Inclusive upper age of each band; a band's points are its position.
AGE_BANDS = (50, 60, 70, 80)

NAMES = tuple(name for name, *_ in CATEGORIES)


def expand(text: str) -> list[str]:
    """'430-432 V43' -> ['430', '431', '432', 'V43'], zero-padded like the bounds."""
    out = []
    for token in text.split():
        span = re.fullmatch(r"([A-Z]?)(\d+)-[A-Z]?(\d+)", token)
        if not span:
            out.append(token)
            continue
        letter, low, high = span.groups()
        out += [f"{letter}{n:0{len(low)}d}" for n in range(int(low), int(high) + 1)]
    return out


def prefixes() -> list[tuple[int, str, str]]:
    return [
        (version, prefix, name)
        for name, _, ninth, tenth in CATEGORIES
        for version, text in ((9, ninth), (10, tenth))
        for prefix in expand(text)
    ]


def prefix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(prefixes(), "icd_version int, prefix string, category string")


def clean_code(code: Column, strip_dots: bool = False) -> Column:
    trimmed = F.upper(F.trim(code))
    return F.replace(trimmed, F.lit("."), F.lit("")) if strip_dots else trimmed


def category_flags(diagnoses: DataFrame, strip_dots: bool = False) -> DataFrame:
    """One row per admission with a 0/1 column per category.

    Every code is cut to each prefix length in use, so a match is a hash join with the few hundred
    table rows and not a scan over a list of patterns. The categories of a prefix are bits of one
    number: a code stays one row, and an admission adds up one number.
    """
    bits = F.create_map(*[x for i, n in enumerate(NAMES) for x in (F.lit(n), F.lit(1 << i).cast("long"))])
    table = prefix_table(diagnoses.sparkSession).groupBy("icd_version", "prefix").agg(
        F.bit_or(bits[F.col("category")]).alias("_bits"))
    code = clean_code(F.col("icd_code"), strip_dots)
    found = diagnoses.select("hadm_id", "icd_version", code.alias("_code"))
    marks = []
    for n in sorted({len(p) for _, p, _ in prefixes()}):
        # The table has a few hundred rows, fixed by configuration. Codes that match nothing keep
        # their admission, with zeros.
        cut = table.where(F.length("prefix") == n).select(
            "icd_version", F.col("prefix").alias(f"_cut{n}"), F.col("_bits").alias(f"_bits{n}"))
        found = found.withColumn(f"_cut{n}", F.left("_code", F.lit(n))).join(
            F.broadcast(cut), ["icd_version", f"_cut{n}"], "left").drop(f"_cut{n}")
        marks.append(F.coalesce(f"_bits{n}", F.lit(0)))
    mark = marks[0]
    for other in marks[1:]:
        mark = mark.bitwiseOR(other)
    per_admission = found.groupBy("hadm_id").agg(F.bit_or(mark).alias("_bits"))
    return per_admission.select("hadm_id", *[
        F.col("_bits").bitwiseAND(F.lit(1 << i)).cast("boolean").cast("int").alias(f"cci_{n}")
        for i, n in enumerate(NAMES)])


def version_counts(diagnoses: DataFrame) -> DataFrame:
    """Codes and how many of them follow each version of the classification, one row."""
    return diagnoses.agg(
        F.count(F.lit(1)).alias("codes"), F.count_if(F.col("icd_version") == 9).alias("icd9"),
        F.count_if(F.col("icd_version") == 10).alias("icd10"))


def score(hierarchy: bool = True) -> Column:
    """Weighted sum over cci_* columns."""
    total = F.lit(0)
    for name, weight, *_ in CATEGORIES:
        flag = F.coalesce(F.col(f"cci_{name}"), F.lit(0))
        if hierarchy and name in GRADED:
            severe = F.coalesce(F.col(f"cci_{GRADED[name]}"), F.lit(0))
            flag = F.when(severe == 1, 0).otherwise(flag)
        total = total + weight * flag
    return total


def age_points(age: Column) -> Column:
    """Points by inclusive age band; an unknown age scores nothing."""
    points = F.when(age.isNull(), 0)
    for position, upper in enumerate(AGE_BANDS):
        points = points.when(age <= upper, position)
    return points.otherwise(len(AGE_BANDS))
