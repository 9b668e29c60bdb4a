"""Exact quantiles per group that never gather a group in one task.

`percentile` keeps a group's distinct values in one aggregation buffer, so a group with a third of all rows ends in
one task. Here the values are first counted (combined map-side), then bucketed by a monotone function: totals of coarse
steps locate the steps that hold the wanted ranks, only their values are put into fine steps, and of those only the ones that
hold a rank are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Coarse steps are few for a group of any size; fine ones keep the part that is ordered small.
_COARSE, _FINE = 32, 4096
_RESOLUTION = 1e6


def value_step(value: Column, per_octave: int = _FINE) -> Column:
    """Order-preserving bucket, the same for every group; about 0.02 % wide by default."""
    size = F.floor(F.log2(1.0 + F.abs(value) * _RESOLUTION) * per_octave)
    return F.when(value < 0, -size).otherwise(size)


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    amount = F.count("*") if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(amount.alias("n"))


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of a (keys, value, n) table: one row per key with `total` and each named quantile."""
    position = {name: F.lit(p) * (F.col("total") - 1) for name, p in probs.items()}
    ranks = F.array(*[
        F.struct(F.lit(f"{name}_{side}").alias("name"), rounder(position[name]).cast("bigint").alias("rank"))
        for name in probs for side, rounder in (("lo", F.floor), ("hi", F.ceil))
    ])

    def held(start: Column, size: Column) -> Column:
        """The wanted ranks between `start` and `start + size`."""
        return F.filter(ranks, lambda r: (r["rank"] >= start) & (r["rank"] < start + size))

    def running(column: str, *by: str, order: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    steps = counts.withColumn("_coarse", value_step(F.col(value), _COARSE))
    totals = steps.groupBy(*keys, "_coarse").agg(F.sum("n").alias("_size"))
    placed = totals.withColumns({"_before": running("_size", *keys, order="_coarse"), "total": F.sum("_size").over(Window.partitionBy(*keys))})
    wanted = placed.filter(F.size(held(F.col("_before"), F.col("_size"))) > 0).drop("_size")
    near = steps.join(wanted, [*keys, "_coarse"]).withColumn("_fine", value_step(F.col(value)))
    within = [*keys, "_coarse"]
    finer = near.groupBy(*within, "_fine", "_before", "total").agg(F.sum("n").alias("_size"))
    finer = finer.withColumn("_start", F.col("_before") + running("_size", *within, order="_fine"))
    finer = finer.filter(F.size(held(F.col("_start"), F.col("_size"))) > 0).select(*within, "_fine", "_start")
    ordered = near.drop("_before").join(finer, [*within, "_fine"])
    ordered = ordered.withColumn("_start", F.col("_start") + running("n", *within, "_fine", order=value))
    found = ordered.select(*keys, "total", F.col(value).alias("_v"), F.explode(held(F.col("_start"), F.col("n"))).alias("_r"))
    picked = found.groupBy(*keys).agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("_r.name") == f"{n}_{s}", F.col("_v"))).alias(f"_{n}_{s}") for n in probs for s in ("lo", "hi")],
    )
    blended = []
    for name in probs:
        lo, hi, at = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), position[name]
        blended.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, "total", *blended)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    return quantiles_of_counts(value_counts(df, keys, value, weight), keys, value, probs)
