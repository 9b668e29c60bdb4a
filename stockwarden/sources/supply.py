"""Pending supply, scheduled cases and case headers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.config import CLOSED_STATES
from stockwarden.functions.maths import to_base_unit


def _literal(moment: datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def _in_base(df: DataFrame, base_units: DataFrame, factors: DataFrame, qty: str) -> DataFrame:
    """Document quantity to the product's base unit; unknown units pass through."""
    doc = factors.select(F.col("name").alias("unit_doc"), F.col("factor").alias("doc_factor"))
    base = factors.select(F.col("name").alias("base_unit"), F.col("factor").alias("base_factor"))
    return (
        df.join(base_units.select("product_id", "base_unit"), "product_id", "left")
        .join(doc, "unit_doc", "left").join(base, "base_unit", "left")
        .withColumn("qty", F.round(to_base_unit(F.col(qty), F.col("doc_factor"), F.col("base_factor")), 3))
        .drop("doc_factor", "base_factor", "base_unit")
    )


def pending_purchases(lines: DataFrame, orders: DataFrame, receipt_types: DataFrame, base_units: DataFrame,
                      factors: DataFrame, as_of: datetime) -> DataFrame:
    """Confirmed purchase lines still to be received, each counted once, in base units."""
    # Line states that count and order states that do not.
    live, dead = ("purchase", "done"), ("cancel", "draft", "sent", "to approve")
    open_lines = lines.filter(F.col("state").isin(*live)).withColumn(
        "qty_doc", F.coalesce("ordered", F.lit(0.0)) - F.coalesce("received", F.lit(0.0))).filter("qty_doc > 0")
    heads = orders.select("order_id", F.col("order_ref").alias("ref"), "supplier", "receipt_type_id",
                          F.col("order_state"), F.col("planned").alias("order_planned"))
    incoming = receipt_types.select("receipt_type_id", "to_location")
    rows = (
        open_lines.join(heads, "order_id", "left")
        .filter(~F.coalesce(F.col("order_state"), F.lit("")).isin(*dead))
        .join(incoming, "receipt_type_id", "left")
    )
    due = F.coalesce("planned", "order_planned")
    return _in_base(rows, base_units, factors, "qty_doc").select(
        F.lit("purchase").alias("kind"), "ref", "supplier", "product_id", "qty", "qty_doc", "unit_doc",
        F.coalesce("to_location", F.lit("")).alias("to_location"), F.col("supplier").alias("from_location"),
        due.alias("due_at"), F.lit(True).alias("confirmed"), F.coalesce(due < _literal(as_of), F.lit(False)).alias("late"),
    )


def pending_transfers(moves: DataFrame, base_units: DataFrame, factors: DataFrame, as_of: datetime) -> DataFrame:
    """Unfinished moves between internal places; receipts from suppliers are already counted as purchases."""
    # States of an unfinished move and those that confirm it.
    waiting = ("draft", "waiting", "confirmed", "partially_available", "assigned")
    firm = ("assigned", "confirmed", "partially_available", "waiting")
    rows = moves.filter(F.col("state").isin(*waiting) & (F.col("from_usage") == "internal") & (F.col("to_usage") == "internal"))
    late = F.coalesce(F.col("due_at") < _literal(as_of - timedelta(days=1)), F.lit(False))
    converted = _in_base(rows, base_units, factors, "qty_doc")
    return converted.select(
        F.lit("transfer").alias("kind"), "ref", F.lit("").alias("supplier"), "product_id",
        F.coalesce(F.nullif("base_qty", F.lit(0.0)), "qty").alias("qty"), "qty_doc", "unit_doc", "to_location",
        "from_location", "due_at", F.col("state").isin(*firm).alias("confirmed"), late.alias("late"),
    )


def pending_supply(purchases: DataFrame, transfers: DataFrame) -> DataFrame:
    return purchases.unionByName(transfers)


def scheduled_cases(headers: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Cases that are still to happen, per hospital and day."""
    future = (F.col("surgery_day") > _literal(as_of)) & (F.col("surgery_day") <= _literal(as_of + timedelta(days=days)))
    return (
        headers.filter(future & ~F.coalesce(F.col("state"), F.lit("")).isin(*CLOSED_STATES))
        .groupBy("hospital", "hospital_id", F.col("surgery_day").cast("date").alias("day"))
        .agg(F.count("*").alias("cases"))
    )
