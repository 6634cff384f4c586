"""Every registered query of the core with its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ["reference", "rejects", "drift", "intervals", "contracts"]


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"sparkseek.queries.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
