"""All queries of the core, by name."""

from __future__ import annotations

import importlib
import pkgutil

from . import __name__ as here
from . import __path__ as folder

QUERIES: dict = {}
SQL: dict = {}
for _module in sorted(m.name for m in pkgutil.iter_modules(folder)):
    if _module != "registry":
        _m = importlib.import_module(f"{here}.{_module}")
        QUERIES |= _m.QUERIES
        SQL |= _m.SQL
