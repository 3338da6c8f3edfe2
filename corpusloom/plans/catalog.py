"""All registered queries. Importing the plan modules fills the registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.registry import CHECKS, PLANS, runnable

MODULES = [
    "files",
    "scalars",
    "chunks",
    "extraction",
    "graph",
    "retrieval",
    "references",
    "operations",
    "streams",
]
for _name in MODULES:
    importlib.import_module(f"corpusloom.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(plan) for name, plan in PLANS.items()}


def checks() -> dict[str, str]:
    return dict(CHECKS)
