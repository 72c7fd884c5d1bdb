"""Import every query module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ["q_features", "q_clean", "q_fusion", "q_logs", "q_eval", "q_select", "q_models", "q_explain", "q_sources", "q_stream"]

for _m in MODULES:
    importlib.import_module(f"{__package__}.{_m}")

from .registry import ORACLE, QUERIES  # noqa: E402

__all__ = ["QUERIES", "ORACLE"]
