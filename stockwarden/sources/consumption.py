"""Consumption lines: clinical lines with their case headers, or finished stock moves when those are missing."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import CANCELLED_STATES
from stockwarden.functions.dates import duration_minutes, real_timestamp
from stockwarden.functions.text import blank_to_null, warehouse
from stockwarden.schema import CONSUMPTION

# Line attributes that fall back to the case header when the line leaves them blank.
HEADER_ATTRIBUTES = (
    "hospital", "doctor", "technician", "sublocation", "operating_room", "surgery_kind", "specialty",
    "event_kind", "shift", "case_state", "surgeon", "package",
)


def window(start: date | None, end: date | None, as_of: datetime, days: int = 180) -> tuple[datetime, datetime]:
    """End of the last day and start of the first; without dates, the `days` up to `as_of`."""
    upper = datetime.combine(end, datetime.max.time()).replace(microsecond=0) if end else as_of
    lower = datetime.combine(start, datetime.min.time()) if start else as_of - timedelta(days=days)
    return lower, upper


def in_window(ts: Column, bounds: tuple[datetime, datetime]) -> Column:
    lower, upper = (F.lit(b.isoformat(sep=" ")).cast("timestamp_ntz") for b in bounds)
    return (ts >= lower) & (ts <= upper)


def consumption_lines(table: DataFrame, bounds: tuple[datetime, datetime], products: list[int] | None = None,
                      hospitals: list[str] | None = None) -> DataFrame:
    """Stored lines of a window; every predicate reaches the Parquet scan."""
    rows = table.filter(in_window(F.col("ts"), bounds))
    if products:
        rows = rows.filter(F.col("product_id").isin(products))
    if hospitals:
        rows = rows.filter(F.col("hospital").isin(hospitals))
    return rows


def effective_product(lines: DataFrame) -> DataFrame:
    """The variant that really moved replaces the ordered one."""
    return lines.withColumns({
        "product_id": F.coalesce("effective_product_id", "product_id"),
        "product": F.when(F.col("effective_product_id").isNotNull(),
                          F.coalesce(blank_to_null(F.col("effective_product")), "product")).otherwise(F.col("product")),
    }).drop("effective_product_id", "effective_product")


def with_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines of cases that were not cancelled, with the header's real time, duration, people and place.

    A line whose header is absent stays, with what it has itself.
    """
    shared = [c for c in HEADER_ATTRIBUTES if c in headers.columns]
    cases = headers.select(
        F.col("case_id"),
        F.coalesce(F.col("state").isin(*CANCELLED_STATES), F.lit(False)).alias("h_cancelled"),
        F.col("case_no").alias("h_case_no"),
        F.col("picking_id"),
        real_timestamp(F.col("surgery_day"), F.col("start_hour"), F.col("start_ts"), F.col("registered")).alias("h_ts"),
        F.col("start_hour"), F.col("end_hour"), F.col("start_ts"), F.col("end_ts"),
        *[F.col(c).alias(f"h_{c}") for c in shared],
    )
    joined = lines.join(cases, "case_id", "left").filter(~F.coalesce("h_cancelled", F.lit(False))).drop("h_cancelled")
    merged = {
        c: F.coalesce(blank_to_null(F.col(c)), blank_to_null(F.col(f"h_{c}")), F.lit(""))
        if c in lines.columns else F.coalesce(F.col(f"h_{c}"), F.lit(""))
        for c in shared
    }
    return joined.withColumns({
        **merged,
        "ts": F.coalesce("h_ts", "ts"),
        "case_no": F.coalesce(blank_to_null(F.col("h_case_no")), F.col("case_no")),
        "duration_min": duration_minutes(F.col("start_hour"), F.col("end_hour"), F.col("start_ts"), F.col("end_ts"),
                                         F.col("duration_min")),
    }).drop("h_ts", "h_case_no", "start_hour", "end_hour", "start_ts", "end_ts", *[f"h_{c}" for c in shared])


def first_lots(moves: DataFrame) -> DataFrame:
    """The first lot moved per (picking, product): one aggregate row each, whatever the number of moves."""
    return (
        moves.filter(blank_to_null(F.col("lot")).isNotNull())
        .groupBy("picking_id", "product_id")
        .agg(F.min_by(F.struct("lot", "expiry"), "move_id").alias("first"))
        .select("picking_id", "product_id", F.col("first.lot").alias("lot"), F.col("first.expiry").alias("expiry"))
    )


def with_lots(lines: DataFrame, moves: DataFrame) -> DataFrame:
    found = first_lots(moves)
    return lines.drop("lot", "expiry").join(found, ["picking_id", "product_id"], "left").withColumn(
        "lot", F.coalesce("lot", F.lit("")))


def value_at_cost(lines: DataFrame, costs: DataFrame, base_unit_only: bool = False) -> DataFrame:
    """Amounts at standard cost, only when no line of the source carries an amount at all.

    With `base_unit_only` a line is valued only when its unit is the product's base unit (stock-move fallback).
    """
    has_amount = lines.agg((F.coalesce(F.sum(F.abs("amount")), F.lit(0.0)) > 0).alias("has")).scalar()
    priced = lines.join(costs.select("product_id", "standard_cost", "base_unit"), "product_id", "left")
    usable = F.coalesce(F.col("standard_cost") > 0, F.lit(False))
    if base_unit_only:
        usable = usable & F.coalesce(F.col("base_unit") == F.col("unit"), F.lit(True))
    estimate = F.when(usable, F.round(F.col("qty") * F.col("standard_cost"), 2)).otherwise(0.0)
    return (
        priced.withColumn("has_amount", has_amount)
        .withColumn("amount", F.when(F.col("has_amount"), F.col("amount")).otherwise(estimate))
        .withColumn("amount_estimated", ~F.col("has_amount") & usable)
        .drop("standard_cost", "base_unit", "has_amount")
    )


def complete(lines: DataFrame) -> DataFrame:
    """The fixed schema: '' for absent text, numbers cast, zero quantities and undated lines dropped."""
    typed = []
    for field in CONSUMPTION.fields:
        kind = field.dataType.simpleString()
        if field.name not in lines.columns:
            value = F.lit(None).cast(kind)
        elif kind in ("double", "timestamp_ntz"):
            value = F.col(field.name).try_cast(kind)
        else:
            value = F.col(field.name).cast(kind)
        if kind == "string" and field.name != "line_id":
            value = F.coalesce(value, F.lit(""))
        if kind == "boolean":
            value = F.coalesce(value, F.lit(False))
        typed.append(value.alias(field.name))
    rows = lines.select(*typed)
    return (
        rows.withColumn("qty", F.coalesce("qty", F.lit(0.0)))
        .withColumn("amount", F.coalesce("amount", F.lit(0.0)))
        .withColumn("warehouse", F.coalesce(blank_to_null(F.col("warehouse")), warehouse(F.col("sublocation"))))
        .withColumn("day", F.col("ts").cast("date"))
        .filter((F.col("qty") != 0) & F.col("ts").isNotNull())
    )


def clinical_consumption(lines: DataFrame, headers: DataFrame, moves: DataFrame, costs: DataFrame) -> DataFrame:
    rows = with_headers(effective_product(lines), headers)
    return complete(value_at_cost(with_lots(rows, moves), costs).withColumn("source", F.lit("clinical")))


def fallback_consumption(moves: DataFrame, costs: DataFrame) -> DataFrame:
    """Finished moves out of internal locations stand in for clinical lines."""
    # Destinations that mean consumption.
    outward = ("customer", "production", "inventory", "transit")
    rows = moves.filter(
        (F.col("state") == "done") & (F.col("from_usage") == "internal") & F.col("to_usage").isin(*outward)
    ).select(
        F.col("move_id").cast("string").alias("line_id"), "ts", F.col("reference").alias("case_no"), "product_id",
        "product", "unit", "lot", "expiry", "qty", F.col("to_location").alias("hospital"),
        F.col("from_location").alias("sublocation"), F.lit(0.0).alias("amount"),
    )
    return complete(value_at_cost(rows, costs, base_unit_only=True).withColumn("source", F.lit("stock_moves")))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key by an explicit order, for small per-key tables."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")
