"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

import importlib

MODULES = ("toxicity", "language", "mixing", "pii", "quality_rules", "quality", "spotsigs", "sentencepiece_bpe", "token_counts", "ngram_join", "resampling", "runs", "sharding")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
