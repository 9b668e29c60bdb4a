"""One consumption run: lines in, findings, patterns, profiles, risk and history out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig
from stockwarden.operators import forest, fuse, history, patterns, profiles, risk, rules
from stockwarden.operators.features import container_capacity, line_features
from stockwarden.session import materialize


def prepare(lines: DataFrame, profile_table: DataFrame, capacity: DataFrame | None = None, density: DataFrame | None = None) -> DataFrame:
    """Lines with their product's container size, density and median rate.

    The product table has one row per product; being stored, its size is known when the join is planned.
    """
    sizes = container_capacity(lines, manual=capacity).select("product_id", "capacity")
    rates = profile_table.filter("scope = 'product' and metric = 'rate'").select("product_id", F.col("median").alias("product_rate"))
    dims = sizes.join(rates, "product_id", "left")
    if density is not None:
        dims = dims.join(density.select("product_id", "density"), "product_id", "left")
    else:
        dims = dims.withColumn("density", F.lit(None).cast("double"))
    return lines.join(materialize(dims, "product-dims"), "product_id", "left")


def run_consumption(consumption: DataFrame, cfg: ConsumptionConfig, adjustments: DataFrame | None = None,
                    justified: DataFrame | None = None, capacity: DataFrame | None = None,
                    density: DataFrame | None = None, with_forest: bool = True) -> dict[str, DataFrame]:
    """Tables of one run. Lines, profiles, findings and patterns are written once, because later steps share them."""
    lines = materialize(line_features(consumption, cfg), "lines")
    profile_table = materialize(profiles.build_profiles(lines), "profiles")
    cuts = materialize(profiles.cutoffs(lines, profile_table, cfg, adjustments), "cutoffs")
    prepared = prepare(lines, profile_table, capacity, density)
    forest_part = forest.forest_hits(lines, cfg) if with_forest else None
    found = materialize(fuse.findings(lines, rules.all_hits(prepared, cuts, cfg, forest_part), cfg, justified), "findings")
    pattern_table = materialize(patterns.all_patterns(lines, found, cfg), "patterns")
    return {
        "findings": found,
        "patterns": pattern_table,
        "profiles": profile_table,
        "risk": risk.risk_index(found, pattern_table, lines),
        "scale": rules.scale_summary(prepared, cfg),
        "monthly": history.monthly(lines),
        "trends": history.product_trends(lines),
        "hospitals": history.hospital_comparison(lines),
        "seasonality": history.seasonality(lines),
        "year_over_year": history.year_over_year(lines),
        "structural_changes": history.structural_changes(lines),
        "kpis": fuse.run_kpis(lines, found, pattern_table),
    }
