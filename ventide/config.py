"""Clinical rules and parameters of the pipeline."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. They must equal the published pipeline's for results to match.
# ---------------------------------------------------------------------------

# Time-series parameters, in column order, with the chart items they are read from
# (first item with a value wins).
PARAM_ITEMS: dict[str, tuple[int, ...]] = {
    "spo2": (220277,),
    "fio2": (223835,),
    "flow_rate": (224691,),
    "peep": (224700, 220339),
    "pip": (224695,),
    "respiratory_rate_total": (224690,),
    "minute_volume": (224687,),
    "tidal_volume_observed": (224685,),
    "etco2": (228640,),
    "inspiratory_ratio": (226873,),
    "expiratory_ratio": (226871,),
}

# Values outside the range become null (they are not clipped).
PLAUSIBLE: dict[str, tuple[float, float]] = {
    "spo2": (0.0, 100.0),
    "fio2": (21.0, 100.0),
    "flow_rate": (0.0, 150.0),
    "peep": (0.0, 35.0),
    "pip": (0.0, 80.0),
    "respiratory_rate_total": (0.0, 70.0),
    "minute_volume": (0.0, 40.0),
    "tidal_volume_observed": (0.0, 2000.0),
    "etco2": (0.0, 100.0),
    "inspiratory_ratio": (0.0, 10.0),
    "expiratory_ratio": (0.0, 20.0),
}

# Display name, unit and decimals per parameter.
PARAM_DISPLAY: dict[str, tuple[str, str, int]] = {
    "spo2": ("SpO2", "%", 0),
    "fio2": ("FiO2", "%", 0),
    "flow_rate": ("flow rate", "L/min", 1),
    "peep": ("PEEP", "cmH2O", 0),
    "pip": ("PIP", "cmH2O", 0),
    "respiratory_rate_total": ("respiratory rate", "/min", 0),
    "minute_volume": ("minute volume", "L/min", 1),
    "tidal_volume_observed": ("tidal volume", "mL", 0),
    "etco2": ("EtCO2", "mmHg", 0),
    "inspiratory_ratio": ("I:E inspiratory part", "", 1),
    "expiratory_ratio": ("I:E expiratory part", "", 1),
}

ITEM_FIO2 = 223835
ITEM_PEEP_SET = 220339
ITEM_VENT_MODE = 223849
ITEM_O2_DEVICE = 226732
ITEM_INVASIVE_VENT = 225792
INVASIVE_DEVICES = ("Endotracheal tube", "Tracheostomy tube")

# Further items kept by the one big scan although the model does not use them.
CACHED_EXTRA_ITEMS = (
    223834, 224700, 220210, 224696, 224697, 229661, 224684, 224421, 224422, 229393, 220045,
    223761, 223762, 220052, 220546, 220283, 223849, 223848, 226732, 226512, 226531, 224639,
    226730, 226707,
)

# Body metric items with the factor to kg or cm, and the accepted ranges.
WEIGHT_ITEMS = {226512: 1.0, 224639: 1.0, 226531: 0.45359237}
HEIGHT_ITEMS = {226730: 1.0, 226707: 2.54}
WEIGHT_RANGE_KG = (20.0, 400.0)
HEIGHT_RANGE_CM = (100.0, 250.0)
CM_PER_INCH = 2.54

# Drug groups, matched against lower-cased item labels.
DRUG_PATTERNS: dict[str, str] = {
    "vasopressor": "norepinephrine|epinephrine|phenylephrine|vasopressin|dopamine",
    "sedative": "propofol|midazolam|dexmedetomidine|lorazepam|ketamine",
    "opioid": "fentanyl|morphine|hydromorphone|remifentanil",
    "paralytic": "cisatracurium|rocuronium|vecuronium|succinylcholine",
    "inotrope": "dobutamine|milrinone",
}

FIO2_FRACTION_MAX = 1.0
LOCF_CUTOFF_MIN = 240.0
COMPANIONS = ("observed", "delta_t_min", "locf", "structurally_missing_in_stay", "final")

REINTUBATION_WINDOW_H = 48
PROLONGED_VENT_H = 168

STRATA_EDGES = (1e-12, 0.02, 0.10, 0.30)
TEST_FRACTION = 0.2
N_FOLDS = 5
SEED = 42

VAC_PEEP_RISE = 3.0
VAC_FIO2_RISE = 20.0
VAC_MIN_DAYS = 4
HOURLY_HORIZON_H = 6
DESATURATION_BELOW = 88.0

RELIABILITY_BINS = 15
BUDGET_GRID_POINTS = 400
BUDGET_GRID_SPAN = (0.05, 0.99999)
BUDGET_COARSE_POINTS = 25
LOGIT_EPS = 1e-12
ALERT_BUDGETS = (1.0, 2.0, 4.0)

BAND_NAMES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
BAND_BUDGETS = (0.70, 0.45, 0.20)
SWEEP_PROMOTE_DWELL_MIN = (0.0, 30.0, 60.0)
SWEEP_DEMOTE_MARGIN = (0.0, 0.25, 0.5)
SWEEP_DEMOTE_DWELL_MIN = (0.0, 60.0, 120.0)
MAX_LOST_LEAD_MIN = 30.0
MAX_FLIP_INCREASE = 0.25
RATE_QUANTILES = (0.02, 0.10, 0.25, 0.50, 0.75, 0.90, 0.98)
BAND_RATE_TOLERANCE = 0.02

GATE_SHARE_TOLERANCE = 0.01

MAX_IMPUTED_SHARE = 0.30
MAX_DOC_SHARE = 0.30
CONTRIBUTOR_TOP_K = 8
EXPLAIN_CONTRIBUTOR_K = 5
RECONSTRUCTION_TOLERANCE = 1e-5
INSUFFICIENT_TEXT = "Insufficient data"
UNAVAILABLE_TEXT = "LLM explanation and recommendations are not available"
RECORD_SCHEMA_VERSION = "1.2.0"

CHUNK_MIN_WORDS = 25
CHUNK_MAX_WORDS = 320
MATH_ITALIC_MAX_RUN = 3
EVIDENCE_CONTEXT_K = 1
EVIDENCE_ACTIONS_K = 2
EVIDENCE_MIN_ANCHORS = 2
RANK_TOP_N = 12
RRF_K = 60
KIND_PRIORITY = ("recommendation", "table", "prose")

# Query vocabulary of the evidence map: anchor terms per parameter, intent per band and
# context terms per kind of feature.
PARAM_TERMS: dict[str, tuple[str, ...]] = {
    "spo2": ("SpO2", "oxygen saturation", "pulse oximetry", "oximetry", "saturation",
             "hypoxemia", "normoxemia"),
    "fio2": ("FiO2", "FIO2", "oxygen concentration", "fraction of inspired oxygen",
             "inspired oxygen"),
    "flow_rate": ("flow rate", "inspiratory flow", "peak flow"),
    "peep": ("PEEP", "positive end-expiratory pressure", "end-expiratory pressure",
             "auto-PEEP", "CPAP"),
    "pip": ("PIP", "peak inspiratory pressure", "peak pressure", "peak airway pressure"),
    "respiratory_rate_total": ("respiratory rate", "breathing frequency", "breaths/minute",
                               "breaths per minute", "tachypnea"),
    "minute_volume": ("minute ventilation", "minute volume", "VE"),
    "tidal_volume_observed": ("tidal volume", "VT", "mL/kg", "lung-protective",
                              "lung protective", "predicted body weight"),
    "etco2": ("EtCO2", "end-tidal", "capnography", "carbon dioxide"),
    "inspiratory_ratio": ("I:E", "I:E ratio", "inspiratory time", "inspiratory-to-expiratory"),
    "expiratory_ratio": ("I:E", "I:E ratio", "expiratory time", "inspiratory-to-expiratory"),
}
BAND_TERMS: dict[str, tuple[str, ...]] = {
    "LOW": ("weaning", "liberation", "spontaneous breathing trial", "extubation", "readiness",
            "reduce support"),
    "MEDIUM": ("assessment", "assess", "monitoring", "evaluate", "documenting"),
    "HIGH": ("lung-protective", "adjust", "escalation", "increase support",
             "ventilator adjustments", "assess"),
    "CRITICAL": ("escalation", "urgent", "deterioration", "physician", "lung-protective",
                 "assess"),
}
KIND_TERMS: dict[str, tuple[str, ...]] = {
    "physiology": ("patient-ventilator assessment", "assessment", "physiologic",
                   "clinical assessment"),
    "documentation": ("documentation", "documenting", "recorded", "charting", "surveillance",
                      "data collection", "reporting"),
}

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------

PARAMS = tuple(PARAM_ITEMS)
SOURCE_ITEMS = tuple(sorted({i for items in PARAM_ITEMS.values() for i in items}))
CACHED_ITEMS = tuple(sorted({*SOURCE_ITEMS, *CACHED_EXTRA_ITEMS}))
DRUG_GROUPS = tuple(DRUG_PATTERNS)


@dataclass(frozen=True)
class LabelRules:
    horizons_h: tuple[int, ...] = (2, 6, 12)
    primary_h: int = 6
    fio2_rise: float = 20.0
    peep_rise: float = 3.0
    spo2_below: float = 88.0
    strict_baseline_age_min: float = 60.0
    fio2_persist: bool = True
    pressor_strict: bool = True
    pressor_off_min: int = 360


@dataclass(frozen=True)
class Flags:
    """Plan variants of the published pipeline; each one enters the fingerprint."""

    final_cohort: bool = True
    charlson_hierarchy: bool = True
    body_metrics: bool = True
    split_inotrope: bool = True
    predicted_body_weight: bool = True
    causal: bool = False

    def drug_patterns(self) -> dict[str, str]:
        patterns = dict(DRUG_PATTERNS)
        if not self.split_inotrope:
            patterns["vasopressor"] += "|dobutamine"
            del patterns["inotrope"]
        return patterns


@dataclass(frozen=True)
class Settings:
    labels: LabelRules = field(default_factory=LabelRules)
    flags: Flags = field(default_factory=Flags)
    target: str = "y_resp_6h"

    def fingerprint(self) -> str:
        text = json.dumps(dataclasses.asdict(self), sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()[:16]
