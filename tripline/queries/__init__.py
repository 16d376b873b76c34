"""Registered queries, each next to its SQL twin."""

from __future__ import annotations

import importlib

_MODULES = ("catalog", "timeline", "places", "matching", "ingest", "files")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out.update(getattr(importlib.import_module(f"tripline.queries.{module}"), name))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("SQL")
