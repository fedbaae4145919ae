"""The list of runnable queries: name -> (Spark plan, reference SQL, inventory ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    plan: Plan
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``; ``ids`` are the inventory rows it covers."""

    def register(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(plan, sql, tuple(ids.split()))
        return plan

    return register
