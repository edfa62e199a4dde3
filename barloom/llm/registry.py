"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("substring_dedup", "exact_dedup", "source_mix", "topk_search", "near_dedup", "url_filter", "license_scan", "bpe", "quality", "toxicity", "clustering", "decontaminate", "merkle")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"barloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
