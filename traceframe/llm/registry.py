"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["ann", "best_fit", "decontamination", "fill_middle", "language", "line_dedup", "near_dedup", "packing", "quality", "secrets", "token_files", "warc", "whitening"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"traceframe.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
