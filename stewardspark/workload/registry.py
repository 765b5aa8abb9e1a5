"""Registry of named queries: a Spark callable over the tables and its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.projections import PROJECTIONS, Tables, duck_sql

# All queries on events or runs look back from this day; change requests from the other.
AS_OF = "2024-02-05"
CHANGE_AS_OF = "2001-08-01"
TELEMETRY_AS_OF = "2024-04-15"

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(tables: str, body: str) -> str:
    """``body`` with the named projections as leading common table expressions."""
    ctes = [f"{name} AS ({duck_sql(name)})" for name in tables.split() if name in PROJECTIONS]
    body = body.strip()
    recursive = body.startswith("WITH RECURSIVE ")
    if body.startswith("WITH "):
        ctes.append(body.removeprefix("WITH RECURSIVE ").removeprefix("WITH "))
        head, tail = ",\n".join(ctes), ""
    else:
        head, tail = ",\n".join(ctes), body
    if not ctes:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{tail}"


def query(key: str, tables: str = "", check: str | None = None):
    """Registers ``fn`` under ``key``; ``check`` is SQL over the named ``tables``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if check is not None:
            ORACLES[key] = oracle(tables, check)
        return fn

    return register
