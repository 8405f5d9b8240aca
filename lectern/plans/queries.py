"""All queries over the archive's own operators."""

from __future__ import annotations

import importlib

MODULES = ("searching", "reporting", "texts", "linking", "measuring", "files")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    try:
        _r = importlib.import_module(f"lectern.plans.{_name}").R
    except ModuleNotFoundError as e:
        if e.name != f"lectern.plans.{_name}":
            raise
        continue
    QUERIES |= _r.queries
    ORACLE |= _r.oracle
