"""Report bundles: the tables of a run, one folder each, with a manifest of their completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.operators.replenish import ordered_plan
from stockwarden.operators.risk import DIMENSIONS
from stockwarden.sources.tables import write_report


def consumption_report(run: dict[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """Findings, patterns, one risk table per dimension, trends, comparisons and KPIs of a consumption run."""
    tables = {name: run[name] for name in ("kpis", "scale", "findings", "patterns", "trends", "hospitals", "monthly", "structural_changes", "year_over_year")}
    for dimension in DIMENSIONS:
        tables[f"risk_{dimension}"] = run["risk"].filter(F.col("dimension") == dimension)
    tables["weekdays"] = run["seasonality"].filter("kind = 'weekday'")
    if fmt == "csv":
        tables["findings"] = tables["findings"].withColumns({c: F.array_join(c, "; ") for c in ("methods", "reasons")})
    return write_report(tables, path, fmt)


def supply_report(run: dict[str, DataFrame], path: str, fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """Local plan, network purchases, late deliveries, transfers, expiries, classes, daily forecast by product and history.

    The daily forecast by product has a row per day and product; with `columns` (products as named here) it has a column each.
    """
    plan, forecasts = run["plan"], run["forecasts"]
    named = forecasts.withColumn("item", F.regexp_replace("product", r"[ ,;{}()\n\t=]+", "_"))
    by_day = named.groupBy("day", "item").agg(F.sum("projected").alias("projected"))
    if columns is not None:
        by_day = named.groupBy("day").pivot("item", columns).agg(F.sum("projected"))
    tables = {
        "local_plan": ordered_plan(plan.filter("level = 'local'")),
        "purchases": plan.filter("level = 'network' and suggested > 0"),
        "late": run["late"],
        "transfers": run["transfers"],
        "expiries": run["expiries"],
        "abc_xyz": run["abc_xyz"],
        "daily_by_product": by_day,
        "forecast_detail": forecasts,
        "monthly": run["monthly"],
        "monthly_by_unit": run["monthly_by_unit"],
        "weeks": run["last_26_weeks"],
        "growth": run["growth"],
        "summary": run["summary"],
    }
    return write_report(tables, path, fmt)
