"""Per-line features every rule and profile starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.config import ML_UNITS, VOLATILE_PATTERN, VOLATILE_PATTERN_NARROW, ConsumptionConfig
from stockwarden.functions.text import container_size, present


def is_volatile(narrow: bool = False) -> Column:
    """Measured in mL, named like an anaesthetic, or controlled by weighing."""
    by_unit = F.lower(F.trim("unit")).isin(*ML_UNITS)
    if narrow:
        return by_unit | F.lower("product").rlike(VOLATILE_PATTERN_NARROW)
    return by_unit | F.lower("product").rlike(VOLATILE_PATTERN) | F.coalesce("weighable", F.lit(False))


def is_night(cfg: ConsumptionConfig | None = None) -> Column:
    cfg = cfg or ConsumptionConfig()
    return (F.hour("ts") >= cfg.night_start) | (F.hour("ts") < cfg.night_end)


def unit_cost() -> Column:
    return F.when(F.col("qty") > 0, F.col("amount") / F.col("qty")).otherwise(0.0)


def line_features(lines: DataFrame, cfg: ConsumptionConfig | None = None) -> DataFrame:
    # The name is matched once: the rate reads the answer.
    dated = lines.filter(F.col("ts").isNotNull()).withColumns({
        "hour": F.hour("ts"), "weekday": F.weekday("ts"), "weekend": F.weekday("ts") >= 5, "night": is_night(cfg), "volatile": is_volatile()})
    return dated.withColumns({
        "rate": F.when((F.col("duration_min") > 0) & F.col("volatile"), F.col("qty") / F.col("duration_min")),
        "no_doctor": ~present(F.col("doctor")),
        "unit_cost": unit_cost(),
    })


def container_capacity(lines: DataFrame, master: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """Container size per product: manual value, else master data, else the size stated in the name."""
    # Names are counted first, since a minimum of text is sorted; Spark would drop a plain distinct below a minimum.
    named = lines.groupBy("product_id", "product").agg(F.count("*").alias("n")).filter("n > 0")
    named = named.groupBy("product_id").agg(F.min("product").alias("product"))
    sizes = [container_size(F.col("product"))]
    for i, table in enumerate((master, manual)):
        if table is not None:
            column = f"_given{i}"
            named = named.join(table.select("product_id", F.col("capacity").alias(column)), "product_id", "left")
            sizes.insert(0, F.when(F.col(column) > 0, F.col(column)))
    return named.select("product_id", "product", F.coalesce(*sizes).alias("capacity"))
