"""Risk index of technicians, doctors, hospitals, sublocations and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.config import SEVERITY_POINTS
from stockwarden.functions.maths import saturation_index
from stockwarden.functions.text import present
from stockwarden.operators.adhoc import top_per_group

DIMENSIONS = ("technician", "doctor", "hospital", "sublocation", "product")


def _points(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, p) for s, p in SEVERITY_POINTS.items()], F.lit(1)).cast("double")


def _spread(df: DataFrame, keys: dict[str, Column], *columns: str) -> DataFrame:
    """One row per dimension the row counts for."""
    entries = F.array_compact(F.array(*[
        F.when(present(key), F.struct(F.lit(dim).alias("dimension"), F.trim(key).alias("key"))) for dim, key in keys.items()]))
    return df.select(*columns, F.explode(entries).alias("d")).select("d.*", *columns)


def risk_index(found: DataFrame, patterns: DataFrame, lines: DataFrame, top: int | None = None) -> DataFrame:
    c = F.col
    line_part = _spread(found, {d: c(d) for d in DIMENSIONS}, "severity", "risk_amount").select(
        "dimension", "key", _points(c("severity")).alias("points"), "risk_amount", (c("severity") == "critical").alias("critical"),
        (c("severity") == "high").alias("high"), F.lit(False).alias("critical_pattern"))
    mine = {
        "technician": F.when(c("dimension") == "technician", c("actor")),
        "doctor": F.when(c("dimension") == "doctor", c("actor")),
        "hospital": c("hospital"),
        "sublocation": F.when(c("dimension") == "sublocation", c("key")),
        "product": c("product"),
    }
    pattern_part = _spread(patterns, mine, "severity", "risk_amount").select(
        "dimension", "key", (_points(c("severity")) * 2).alias("points"), "risk_amount", (c("severity") == "critical").alias("critical"),
        F.lit(False).alias("high"), (c("severity") == "critical").alias("critical_pattern"))
    totals = line_part.unionByName(pattern_part).groupBy("dimension", "key").agg(
        F.sum("points").alias("points"), F.count("*").alias("findings"), F.sum("risk_amount").alias("risk_amount"),
        F.count_if("critical").alias("critical"), F.count_if("high").alias("high"), F.bool_or("critical_pattern").alias("critical_pattern"))
    volume = _spread(lines, {d: c(d) for d in DIMENSIONS}, "amount").groupBy("dimension", "key").agg(
        F.count("*").alias("lines"), F.sum("amount").alias("total_amount"))
    rows = totals.join(volume, ["dimension", "key"], "left").withColumns({
        "lines": F.coalesce("lines", F.lit(0)), "total_amount": F.coalesce("total_amount", F.lit(0.0))})
    base = saturation_index(c("points"), c("lines"))
    rows = rows.withColumns({
        "index": F.round(F.when(c("critical_pattern"), F.greatest(base, F.lit(65.0))).otherwise(base), 1),
        "risk_pct": F.when(c("total_amount") != 0, 100 * c("risk_amount") / c("total_amount")).otherwise(0.0)})
    every = 1 << 30
    return top_per_group(rows, ["dimension"], [F.desc("index"), F.desc("risk_amount"), c("key")], every if top is None else top).drop("critical_pattern")
