"""Where queries and their DuckDB SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agrispark.plans.fixtures import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may name the shared views."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return put


def half_up(name: str, places: int) -> Column:
    """A double rounded as SQL engines without decimals do: the scaled double, halves away from zero, scaled back."""
    return F.round(F.col(name) * 10.0**places) / 10.0**places


def rounded(name: str, places: int) -> Column:
    """``F.round`` of a double, by arithmetic where its size and its distance from a half leave no doubt: decimals cost more than most sums."""
    c, unit = F.col(name), 10.0**places
    up = F.floor(c * unit + 0.5)
    plain = (F.abs(c * unit) < 1e9) & (F.abs(c * unit - up) < 0.5 - 1e-6)
    return F.when(plain, up / unit).otherwise(F.round(c, places))
