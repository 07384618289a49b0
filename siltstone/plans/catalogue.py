"""All named queries of the core and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this folder; each has QUERIES and ORACLE by name.
MODULES = ["similarity", "texts", "text_pairs", "annotations", "samples", "evaluations", "events", "files", "answers"]


def _gathered(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"siltstone.plans.{name}"), what)
        if twice := out.keys() & part.keys():
            raise ValueError(f"named twice: {sorted(twice)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE")
