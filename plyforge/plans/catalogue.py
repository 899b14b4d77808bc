"""All queries of the core, collected from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

import plyforge.plans as here

#: name -> query, name -> SQL
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Decorator that adds a query under its function's name, with its SQL."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return add


def _load() -> None:
    for module in pkgutil.iter_modules(here.__path__):
        if module.name != "catalogue":
            importlib.import_module(f"{here.__name__}.{module.name}")


def queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES
