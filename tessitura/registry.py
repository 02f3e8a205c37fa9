"""All queries of the general engine, by name."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE: dict = {}
for _name in ("basics", "alignment", "joins", "aggregates", "sequences", "streams"):
    _module = importlib.import_module(f"tessitura.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
