"""Registered queries over the derived tables."""

from __future__ import annotations

import importlib

MODULES = ("sources", "adhoc", "consumption", "supply", "ledger", "evidence")


def all_queries():
    from catalogue.registry import REGISTRY

    for module in MODULES:
        importlib.import_module(f"catalogue.{module}")
    return dict(REGISTRY)
