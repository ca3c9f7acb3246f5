"""Registered queries: each module offers QUERIES and ORACLE, keyed by name."""

from __future__ import annotations

import importlib

MODULES = ("evaluation", "curation", "judging", "checks", "joins", "rules", "texts", "mutations", "similar", "sources", "programs")


def collect() -> tuple[dict, dict]:
    """All registered queries and their SQL, in module order."""
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
