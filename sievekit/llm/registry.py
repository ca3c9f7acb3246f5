"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

#: Modules with QUERIES and ORACLE.
MODULES = (
    "packing", "quality", "urls", "secrets", "language", "decontaminate", "jaccard", "lm", "html", "warc",
    "whitening", "mixing", "resampling",
)


def _parts() -> list:
    return [importlib.import_module(f"sievekit.llm.{m}") for m in MODULES]


def queries() -> dict:
    """All queries by name."""
    return {k: f for m in _parts() for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    found = {k: s for m in _parts() for k, s in m.ORACLE.items()}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
