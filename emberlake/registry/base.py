"""Registration of queries with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.registry.domain import Domain, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, flags and whole numbers as bigint: one form for both engines."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        elif kind in ("boolean", "integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind in ("float", "decimal"):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def query(name: str, uses: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(domain)`` as a query, with its SQL over the domain tables in ``uses``."""

    def wrap(fn: Callable[[Domain], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: plain(fn(Domain(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_tables(sql, uses, recursive)
        return fn

    return wrap
