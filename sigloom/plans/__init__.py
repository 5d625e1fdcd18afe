"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

from sigloom.plans.registry import QUERIES, Query

MODULES = ("relational", "statistics", "runs", "windows", "fingerprints", "spectra", "learning", "resampling", "selection", "curves", "responses", "cycles", "recordings", "controls", "storage")


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"sigloom.plans.{name}")
    return dict(QUERIES)
