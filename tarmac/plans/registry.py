"""Import every query module so that the catalog is complete."""

from __future__ import annotations

import importlib

from tarmac.plans import catalog

_MODULES = [
    "tarmac.plans.q_flights",
    "tarmac.plans.q_weather",
    "tarmac.plans.q_split",
    "tarmac.plans.q_models",
    "tarmac.plans.q_flows",
    "tarmac.plans.q_checks",
    "tarmac.plans.q_boost",
]


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def queries():
    _load()
    return dict(catalog.QUERIES)


def oracle_sql():
    _load()
    return dict(catalog.ORACLE)
