"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.corpora import with_corpora
from corpusloom.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None, corpora: tuple[str, ...] = ()) -> Callable[[Plan], Plan]:
    """Register a plan. ``check`` is SQL for the checking database over the same tables."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = plan
        if check is not None:
            CHECKS[name] = with_corpora(check, *corpora) if corpora else check
        return plan

    return add


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, root: str) -> DataFrame:
        # The tables hold zoneless UTC times; casts to instants must read them as such.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plan(Tables(spark, root))

    return run
