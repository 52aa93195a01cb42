"""All named queries and their SQL twins, collected from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ["rir", "geometry", "catalog", "sampling", "timeline", "evaluate", "signals", "features", "sources", "chunks", "stores"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"reverbtable.plans.{name}"), attr)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLE")
