"""Named queries over the given tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from importlib import import_module

MODULES = ["evaluation", "scalars", "cohorts", "learning", "matrices"]


def load_all() -> tuple[dict, dict]:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
    from .registry import ORACLE, QUERIES

    return QUERIES, ORACLE
