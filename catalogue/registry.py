"""Named queries: the Spark form and, where SQL can state it, the equivalent DuckDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.views import Tables, with_views

REGISTRY: dict[str, Query] = {}
CTES: dict[str, str] = {}


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    digits: dict[str, int]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.withColumns({c: F.round(F.col(c), n) + F.lit(0.0) for c, n in self.digits.items()}) if self.digits else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql
        if self.digits:
            rounded = ", ".join(f"ROUND({c}, {n}) + 0.0e0 AS {c}" for c, n in self.digits.items())
            body = f"SELECT * REPLACE ({rounded}) FROM ({self.sql})"
        return with_views(body, CTES)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query. `doubles` lists float columns as `name` (6 decimals) or `name:digits`; both engines round them."""
    digits = {}
    for item in doubles.split():
        column, _, n = item.partition(":")
        digits[column] = int(n or 6)

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, build, sql, digits)
        return build

    return register
