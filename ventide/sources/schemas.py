"""Schemas of the raw tables. Nothing is sniffed: inference costs a pass and is not stable."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "tinyint": T.ByteType(),
    "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(),
    "date": T.DateType(), "boolean": T.BooleanType(),
}


def schema(text: str) -> T.StructType:
    """'a int, b string' as a struct; works in workers, where no session exists."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CHARTEVENTS = schema(
    "subject_id bigint, hadm_id bigint, stay_id bigint, caregiver_id bigint,"
    " charttime timestamp, storetime timestamp, itemid bigint, value string,"
    " valuenum double, valueuom string, warning bigint"
)
ICUSTAYS = schema(
    "subject_id bigint, hadm_id bigint, stay_id bigint, first_careunit string,"
    " last_careunit string, intime timestamp, outtime timestamp, los double"
)
PROCEDUREEVENTS = schema(
    "stay_id bigint, itemid bigint, starttime timestamp, endtime timestamp"
)
INPUTEVENTS = schema(
    "stay_id bigint, itemid bigint, starttime timestamp, endtime timestamp,"
    " rate double, amount double, statusdescription string"
)
D_ITEMS = schema("itemid bigint, label string, linksto string")
PATIENTS = schema(
    "subject_id bigint, gender string, anchor_age int, anchor_year int, dod date"
)
ADMISSIONS = schema(
    "hadm_id bigint, admittime timestamp, dischtime timestamp, deathtime timestamp,"
    " edregtime timestamp, edouttime timestamp, admission_type string,"
    " admission_location string, insurance string, language string, marital_status string,"
    " race string, discharge_location string, hospital_expire_flag int"
)
DIAGNOSES_ICD = schema("hadm_id bigint, icd_version int, icd_code string")

TABLES = {
    "chartevents": ("icu", CHARTEVENTS),
    "icustays": ("icu", ICUSTAYS),
    "procedureevents": ("icu", PROCEDUREEVENTS),
    "inputevents": ("icu", INPUTEVENTS),
    "d_items": ("icu", D_ITEMS),
    "patients": ("hosp", PATIENTS),
    "admissions": ("hosp", ADMISSIONS),
    "diagnoses_icd": ("hosp", DIAGNOSES_ICD),
}
