"""All registered queries and their oracles."""

from __future__ import annotations

import importlib

MODULES = ("timeseries", "statics", "evaluation", "text", "risk", "streams", "serving", "heads", "gate")


def _merge(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"ventide.plans.{name}"), attribute))
    return out


def queries() -> dict:
    return _merge("QUERIES")


def oracles() -> dict:
    return _merge("ORACLES")
