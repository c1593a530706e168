"""Registered queries: a name, a Spark plan and, where SQL can say it, an oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortline.plans.oracle_views import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated plan under its function name."""

    def register(plan: Query) -> Query:
        QUERIES[plan.__name__] = plan
        if sql is not None:
            ORACLES[plan.__name__] = oracle(sql)
        return plan

    return register
