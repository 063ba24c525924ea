"""All queries of the core, with their SQL: one place the entry point reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import extraction, graphs, integrity, linking, records, searches, storing, timeline

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [integrity, timeline, graphs, searches, storing, linking, records, extraction]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= m.queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.oracle_sql()
    return out
