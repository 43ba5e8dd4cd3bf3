"""Named queries and the ANSI SQL that must give the same rows."""

from __future__ import annotations

import importlib

FLAGSHIP = "eb_prior_years"
MODULES = ("features", "effects", "ordered", "profiles", "history", "resolution", "models", "streamed", "encodings", "rows", "lookups", "recovered", "fits", "pools", "regimes", "learners", "lowrank", "taxonomies", "pipelines")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
