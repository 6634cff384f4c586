"""Queries and SQL twins of the llm problems."""

from __future__ import annotations

import importlib

MODULES = ["queries_terms", "queries_vectors", "queries_tokens", "queries_pages"]


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"sparkseek.llm.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
