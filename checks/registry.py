"""Queries and their oracles, one pair per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(key: str, needs: str = "", sql: str | None = None):
    """Register a query under ``key`` with DuckDB SQL over the named fixtures.

    ``sql`` is a select, or starts with a comma and further common table expressions.
    """

    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            body = sql.strip()
            if needs:
                ORACLES[key] = f"with recursive {ctes(needs)} {body}"
            else:
                ORACLES[key] = f"with recursive {body[1:]}" if body.startswith(",") else body
        return fn

    return register
