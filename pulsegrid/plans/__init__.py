"""Runnable queries: every operator applied to the given tables."""
from importlib import import_module
from pkgutil import iter_modules

from pulsegrid.plans.registry import ORACLES, QUERIES

for _m in sorted(m.name for m in iter_modules(__path__)):
    import_module(f"{__name__}.{_m}")

__all__ = ["QUERIES", "ORACLES"]
