"""The derived raw tables once more, as standard SQL for the oracle queries."""

from __future__ import annotations

from ventide.sources.testdata import DRUG_NAMES

_NAMES = ", ".join(f"'{n}'" for n in DRUG_NAMES)

CTES: dict[str, str] = {
    "ev": """
      SELECT event_id, user_id AS stay_id, event_type, value AS v,
             CAST(json_extract(props, '$.k') AS INTEGER) AS k,
             TIMESTAMP '2024-01-01 00:00:00'
               + to_minutes((epoch_us(ts) - 1704067200000000) // 1440000000) AS charttime
      FROM events""",
    "chartevents": """
      SELECT stay_id // 2 AS subject_id, stay_id AS hadm_id, stay_id, charttime, itemid,
             CASE WHEN itemid = 223849 THEN CASE WHEN k % 10 <> 2 THEN 'MODE_' || (k % 5) END
                  WHEN itemid = 226732 THEN CASE WHEN k % 16 = 3 THEN 'Endotracheal tube'
                                                 ELSE 'Nasal cannula' END END AS value,
             round(CASE itemid WHEN 220277 THEN 78 + v % 25 WHEN 224690 THEN v % 90
               WHEN 228640 THEN v % 120
               WHEN 223835 THEN CASE WHEN k % 20 = 0 THEN (v % 100) / 100 ELSE 15 + v % 95 END
               WHEN 224700 THEN v % 45 WHEN 220339 THEN v % 45 WHEN 224695 THEN v % 100
               WHEN 224687 THEN v % 50 WHEN 224685 THEN v * 10 WHEN 224691 THEN v % 180
               WHEN 226873 THEN v % 12 WHEN 226871 THEN v % 25 WHEN 226730 THEN 90 + v % 170
               WHEN 226531 THEN 40 + v END, 2) AS valuenum,
             CASE WHEN v > 100 THEN 1 ELSE 0 END AS warning
      FROM (SELECT *, CASE event_type
              WHEN 'view' THEN CASE k % 3 WHEN 0 THEN 220277 WHEN 1 THEN 224690 ELSE 228640 END
              WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 223835 WHEN k % 4 = 1 THEN 224700
                                     ELSE 220339 END
              WHEN 'purchase' THEN CASE k % 4 WHEN 0 THEN 224695 WHEN 1 THEN 224687
                                     WHEN 2 THEN 224685 ELSE 224691 END
              WHEN 'error' THEN CASE WHEN k % 4 = 0 THEN 226873 WHEN k % 4 = 1 THEN 226871
                                     WHEN k % 4 = 2 THEN 223849 WHEN k % 8 = 3 THEN 226732
                                     WHEN k % 16 = 7 THEN 226730 ELSE 226531 END END AS itemid
            FROM ev WHERE event_type <> 'signup')""",
    "inputevents": """
      SELECT stay_id, k AS itemid, charttime AS starttime,
             CASE WHEN k % 17 <> 0 THEN charttime + to_minutes(CAST(floor(v) AS BIGINT) * 2) END
               AS endtime,
             CASE WHEN k % 13 <> 0 THEN v END AS rate, v * 2 AS amount,
             CASE WHEN k % 19 = 0 THEN 'Rewritten' WHEN k % 23 <> 0 THEN 'FinishedRunning' END
               AS statusdescription
      FROM ev WHERE event_type = 'signup'""",
    "d_items": f"""
      SELECT p_partkey AS itemid,
             ([{_NAMES}])[CAST(p_partkey % 10 AS INTEGER) + 1] || ' ' || p_name AS label,
             CASE WHEN p_partkey % 50 = 49 THEN 'chartevents' ELSE 'inputevents' END AS linksto
      FROM part""",
    "procedures_of_users": """
      SELECT stay_id, CASE WHEN k % 9 = 6 THEN 225794 ELSE 225792 END AS itemid,
             charttime AS starttime,
             CASE WHEN k % 5 <> 0 THEN charttime + to_minutes(CAST(floor(v) AS BIGINT) * 3) END
               AS endtime
      FROM ev WHERE event_type = 'signup' AND k % 3 = 0""",
    "procedures_of_orders": """
      SELECT l_orderkey AS stay_id,
             CASE WHEN l_returnflag = 'N' THEN 225794 ELSE 225792 END AS itemid,
             l_shipdate + to_hours(l_linenumber * 6) AS starttime,
             CASE WHEN l_linenumber <> 7 THEN l_shipdate + to_hours(l_linenumber * 6)
               + to_minutes(CAST(l_quantity * 60 AS BIGINT)) END AS endtime
      FROM lineitem""",
    "icustays": """
      SELECT o_custkey AS subject_id, o_custkey * 10 + year(o_orderdate) % 10 AS hadm_id,
             o_orderkey AS stay_id, o_orderpriority AS first_careunit,
             o_orderstatus AS last_careunit,
             o_orderdate + to_hours(o_orderkey % 24) AS intime,
             o_orderdate + to_hours(o_orderkey % 24) + to_hours(o_orderkey % 11 * 12 + 6)
               AS outtime,
             (o_orderkey % 11 * 12 + 6) / 24.0 AS los
      FROM orders""",
    "patients": """
      SELECT c_custkey AS subject_id,
             CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'M'
                  WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'F' END AS gender,
             CASE WHEN c_custkey % 37 <> 0 THEN 18 + c_custkey % 75 END AS anchor_age,
             1995 + c_nationkey % 5 AS anchor_year,
             CASE WHEN c_custkey % 7 = 0
                  THEN DATE '1996-01-01' + CAST(c_custkey * 13 % 2000 AS INTEGER) END AS dod
      FROM customer""",
    "admissions": """
      SELECT hadm_id, f - INTERVAL 6 HOUR AS admittime, l + INTERVAL 10 DAY AS dischtime,
             CASE WHEN hadm_id % 9 = 0 THEN f + INTERVAL 3 DAY END AS deathtime,
             CASE WHEN hadm_id % 4 <> 0 THEN f - INTERVAL 12 HOUR END AS edregtime,
             f + to_minutes(-420 + hadm_id % 60) AS edouttime,
             'T' || (hadm_id % 4) AS admission_type, 'L' || (hadm_id % 3) AS admission_location,
             'I' || (hadm_id % 5) AS insurance, 'G' || (hadm_id % 2) AS language,
             'M' || (hadm_id % 4) AS marital_status, 'R' || (hadm_id % 6) AS race,
             'D' || (hadm_id % 3) AS discharge_location,
             CASE WHEN hadm_id % 9 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
      FROM (SELECT o_custkey * 10 + year(o_orderdate) % 10 AS hadm_id, min(o_orderdate) AS f,
                   max(o_orderdate) AS l FROM orders GROUP BY 1)""",
    "diagnoses": """
      SELECT s.hadm_id, 9 + l_linenumber % 2 AS icd_version,
             ' ' || lower(CASE WHEN l_linenumber % 2 = 1
               THEN chr(CAST(65 + l_partkey % 26 AS INTEGER))
                    || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') || (l_partkey % 10)
               ELSE lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || (l_suppkey % 10) END)
               AS icd_code
      FROM lineitem JOIN icustays s ON s.stay_id = l_orderkey""",
}

_NEEDS = {
    "chartevents": ["ev"], "inputevents": ["ev"], "procedures_of_users": ["ev"],
    "diagnoses": ["icustays"],
}


def with_sources(names: list[str], extra: dict[str, str], final: str) -> str:
    """Assemble a query: the named source tables, further steps, and the final SELECT."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    steps = [f"{n} AS ({CTES[n]})" for n in ordered]
    steps += [f"{n} AS ({sql})" for n, sql in extra.items()]
    return ("WITH " + ",\n".join(steps) + "\n" if steps else "") + final
