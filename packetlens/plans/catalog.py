"""Registry of queries: a Spark plan and, where SQL can say the same, a comparison statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from packetlens.plans.views import with_views

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, views: list[str] = (), sql: str | None = None, ctes: str = "") -> Callable[[Plan], Plan]:
    """Register a plan under ``name`` with the SQL that must give the same rows."""

    def register(plan: Plan) -> Plan:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(plan, None if sql is None else with_views(list(views), sql, ctes))
        return plan

    return register
