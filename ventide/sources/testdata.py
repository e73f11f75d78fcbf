"""The raw clinical tables, derived from the generic test tables.

Time series: `events` becomes charted values (thirty days squeezed into thirty hours, so
that readings are dense enough for carry-forward), infusions and procedures; a user is a
stay. Static side: an order is a stay, a customer a patient, a line item a diagnosis or a
procedure. Every rule is arithmetic on the given rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventide.session import spread

DRUG_NAMES = ("Norepinephrine", "Propofol", "Fentanyl", "Rocuronium", "Dobutamine",
              "Vasopressin", "Midazolam", "Morphine Sulfate", "Milrinone", "NaCl 0.9%")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plus_minutes(base: str, minutes: str) -> str:
    return (f"timestamp_micros(unix_micros(cast({base} as timestamp))"
            f" + cast({minutes} as bigint) * 60000000)")


_MINUTE = "floor((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 1440000000)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the squeezed clock: stay, minute, kind, value v and payload number k."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "user_id AS stay_id",
        f"timestamp_micros(1704067200000000 + {_MINUTE} * 60000000) AS charttime",
        "event_type",
        "value AS v",
        # {"k": 69}: plain string cuts, because filters on k repeat this expression.
        "cast(substring_index(substring_index(props, ': ', -1), '}', 1) as int) AS k",
    )


_ITEM = """CASE event_type
  WHEN 'view' THEN CASE WHEN k % 3 = 0 THEN 220277 WHEN k % 3 = 1 THEN 224690 ELSE 228640 END
  WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 223835 WHEN k % 4 = 1 THEN 224700
                         ELSE 220339 END
  WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 224695 WHEN k % 4 = 1 THEN 224687
                            WHEN k % 4 = 2 THEN 224685 ELSE 224691 END
  WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 226873 WHEN k % 4 = 1 THEN 226871
                         WHEN k % 4 = 2 THEN 223849 WHEN k % 8 = 3 THEN 226732
                         WHEN k % 16 = 7 THEN 226730 ELSE 226531 END
  END"""
_NUMBER = """CASE itemid
  WHEN 220277 THEN 78 + v % 25 WHEN 224690 THEN v % 90 WHEN 228640 THEN v % 120
  WHEN 223835 THEN CASE WHEN k % 20 = 0 THEN (v % 100) / 100 ELSE 15 + v % 95 END
  WHEN 224700 THEN v % 45 WHEN 220339 THEN v % 45 WHEN 224695 THEN v % 100
  WHEN 224687 THEN v % 50 WHEN 224685 THEN v * 10 WHEN 224691 THEN v % 180
  WHEN 226873 THEN v % 12 WHEN 226871 THEN v % 25 WHEN 226730 THEN 90 + v % 170
  WHEN 226531 THEN 40 + v END"""
_TEXT = """CASE
  WHEN itemid = 223849 AND k % 10 <> 2 THEN concat('MODE_', k % 5)
  WHEN itemid = 226732 AND k % 16 = 3 THEN 'Endotracheal tube'
  WHEN itemid = 226732 THEN 'Nasal cannula' END"""


def chartevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    charted = events(spark, sf_dir).where("event_type <> 'signup'")
    return charted.selectExpr("*", f"{_ITEM} AS itemid").selectExpr(
        "stay_id div 2 AS subject_id",
        "stay_id AS hadm_id",
        "stay_id",
        "charttime",
        "cast(itemid as bigint) AS itemid",
        f"{_TEXT} AS value",
        # Scaled as the SQL rounds: 0.565 * 100 is a little below 56.5, so 0.56.
        f"round(({_NUMBER}) * 100) / 100 AS valuenum",
        "cast(if(v > 100, 1, 0) as bigint) AS warning",
    )


def inputevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup'").selectExpr(
        "stay_id",
        "cast(k as bigint) AS itemid",
        "charttime AS starttime",
        f"CASE WHEN k % 17 <> 0 THEN {_plus_minutes('charttime', 'floor(v) * 2')} END AS endtime",
        "CASE WHEN k % 13 <> 0 THEN v END AS rate",
        "v * 2 AS amount",
        "CASE WHEN k % 19 = 0 THEN 'Rewritten' WHEN k % 23 <> 0 THEN 'FinishedRunning' END"
        " AS statusdescription",
    )


def d_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ", ".join(f"'{n}'" for n in DRUG_NAMES)
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS itemid",
        f"concat(get(array({names}), cast(p_partkey % 10 as int)), ' ', p_name) AS label",
        "if(p_partkey % 50 = 49, 'chartevents', 'inputevents') AS linksto",
    )


def procedures_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'signup' AND k % 3 = 0").selectExpr(
        "stay_id",
        "cast(if(k % 9 = 6, 225794, 225792) as bigint) AS itemid",
        "charttime AS starttime",
        f"CASE WHEN k % 5 <> 0 THEN {_plus_minutes('charttime', 'floor(v) * 3')} END AS endtime",
    )


def procedures_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = _plus_minutes("l_shipdate", "l_linenumber * 360")
    end = _plus_minutes("l_shipdate", "l_linenumber * 360 + l_quantity * 60")
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS stay_id",
        "cast(if(l_returnflag = 'N', 225794, 225792) as bigint) AS itemid",
        f"{start} AS starttime",
        f"CASE WHEN l_linenumber <> 7 THEN {end} END AS endtime",
    )


def icustays(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = "o_orderkey % 24 * 60"
    length = "o_orderkey % 11 * 12 + 6"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS subject_id",
        "o_custkey * 10 + year(o_orderdate) % 10 AS hadm_id",
        "o_orderkey AS stay_id",
        "o_orderpriority AS first_careunit",
        "o_orderstatus AS last_careunit",
        f"{_plus_minutes('o_orderdate', begin)} AS intime",
        f"{_plus_minutes('o_orderdate', f'{begin} + ({length}) * 60')} AS outtime",
        f"({length}) / 24.0D AS los",
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS subject_id",
        "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'M'"
        " WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'F' END AS gender",
        "cast(CASE WHEN c_custkey % 37 <> 0 THEN 18 + c_custkey % 75 END as int) AS anchor_age",
        "cast(1995 + c_nationkey % 5 as int) AS anchor_year",
        "CASE WHEN c_custkey % 7 = 0"
        " THEN date_add(date'1996-01-01', cast(c_custkey * 13 % 2000 as int)) END AS dod",
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = (
        table(spark, sf_dir, "orders")
        .selectExpr("o_custkey * 10 + year(o_orderdate) % 10 AS hadm_id", "o_orderdate AS d")
        .groupBy("hadm_id")
        .agg(F.min("d").alias("first"), F.max("d").alias("last"))
    )
    return spans.selectExpr(
        "hadm_id",
        f"{_plus_minutes('first', '-360')} AS admittime",
        f"{_plus_minutes('last', '14400')} AS dischtime",
        f"CASE WHEN hadm_id % 9 = 0 THEN {_plus_minutes('first', '4320')} END AS deathtime",
        f"CASE WHEN hadm_id % 4 <> 0 THEN {_plus_minutes('first', '-720')} END AS edregtime",
        f"{_plus_minutes('first', '(-420 + hadm_id % 60)')} AS edouttime",
        "concat('T', hadm_id % 4) AS admission_type",
        "concat('L', hadm_id % 3) AS admission_location",
        "concat('I', hadm_id % 5) AS insurance",
        "concat('G', hadm_id % 2) AS language",
        "concat('M', hadm_id % 4) AS marital_status",
        "concat('R', hadm_id % 6) AS race",
        "concat('D', hadm_id % 3) AS discharge_location",
        "if(hadm_id % 9 = 0, 1, 0) AS hospital_expire_flag",
    )


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = ("concat(char(65 + l_partkey % 26), lpad(cast(l_suppkey % 100 as string), 2, '0'),"
             " l_partkey % 10)")
    ninth = "concat(lpad(cast(l_partkey % 1000 as string), 3, '0'), l_suppkey % 10)"
    stays = icustays(spark, sf_dir).selectExpr("stay_id", "hadm_id")
    lines = spread(table(spark, sf_dir, "lineitem")).selectExpr(
        "l_orderkey AS stay_id",
        "cast(9 + l_linenumber % 2 as int) AS icd_version",
        f"concat(' ', lower(if(l_linenumber % 2 = 1, {tenth}, {ninth}))) AS icd_code",
    )
    return lines.join(stays, "stay_id").select("hadm_id", "icd_version", "icd_code")
