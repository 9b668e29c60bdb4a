"""Stock on hand by product, location and lot."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.functions.text import blank_to_null, warehouse


def usable_stock(quants: DataFrame, as_of: datetime, internal_only: bool = True) -> DataFrame:
    """Available = on hand less reservations, never negative; an expired lot is not usable."""
    rows = quants.filter(F.col("usage") == "internal") if internal_only and "usage" in quants.columns else quants
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    expired = F.coalesce(F.col("expiry") < now, F.lit(False))
    available = F.greatest(F.lit(0.0), F.coalesce("qty", F.lit(0.0)) - F.coalesce("reserved", F.lit(0.0)))
    place = warehouse(F.col("location"))
    return rows.select(
        "product_id", "product", "location",
        (F.coalesce(blank_to_null(F.col("warehouse")), place) if "warehouse" in rows.columns else place).alias("warehouse"),
        "lot", "expiry",
        F.coalesce("qty", F.lit(0.0)).alias("qty"),
        F.coalesce("reserved", F.lit(0.0)).alias("reserved"),
        available.alias("available"),
        expired.alias("expired"),
        F.when(expired, 0.0).otherwise(available).alias("usable"),
    )


def stock_by(stock: DataFrame, *keys: str) -> DataFrame:
    return stock.groupBy(*keys).agg(
        F.sum("qty").alias("total"), F.sum("available").alias("available"), F.sum("reserved").alias("reserved"),
        F.sum("usable").alias("usable"),
    )
