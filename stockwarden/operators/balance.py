"""Pending events, schedule floor and the day-by-day balance.

Day 0 is today at close; step t consumes the demand of day t. Arrivals of a day serve that day. An event at or before
today applies today; one beyond the horizon is counted and ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.operators.series import KEYS


def supply_events(pending: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Confirmed, punctual documents inside the horizon as signed quantities per key and day.

    A transfer leaves its origin as well as entering its destination.
    """
    c = F.col
    day = F.when(c("due_at").isNotNull(), F.greatest(F.datediff(c("due_at").cast("date"), F.lit(cfg.as_of)), F.lit(0))).otherwise(1)
    last = F.lit(cfg.as_of).cast("timestamp_ntz") + F.make_dt_interval(F.lit(cfg.horizon))
    live = pending.filter(c("confirmed") & ~c("late") & (c("due_at").isNull() | (c("due_at") <= last)) & c("product_id").isNotNull())
    arrives = F.struct(c("to_location").alias("location"), F.lit(1.0).alias("sign"))
    leaves = F.when((c("kind") == "transfer") & (F.coalesce("from_location", F.lit("")) != ""), F.struct(c("from_location").alias("location"), F.lit(-1.0).alias("sign")))
    rows = live.withColumn("t", day).select(
        "product_id", "t", "ref", "kind", "supplier", "qty", F.explode(F.array_compact(F.array(arrives, leaves))).alias("e"))
    return rows.select("product_id", "e.location", "t", "ref", "kind", "supplier", (c("e.sign") * c("qty")).alias("qty"))


def case_usage(lines: DataFrame, end: Column) -> DataFrame:
    """Quantity a location uses per case of its main hospital, over the last 90 days."""
    recent = lines.withColumn("_end", end).filter(F.col("ts") > F.col("_end") - F.make_dt_interval(F.lit(90)))
    cases = recent.groupBy("hospital").agg(F.count_distinct("case_no").alias("cases"))
    used = recent.groupBy("hospital", *KEYS).agg(F.sum("qty").alias("qty"))
    return used.join(cases, "hospital").filter("cases > 0 and qty <> 0").select(
        "hospital", *KEYS, (F.col("qty") / F.col("cases")).alias("per_case"))


def main_hospitals(lines: DataFrame) -> DataFrame:
    """Most frequent hospital per location; the smallest name wins ties."""
    counts = lines.groupBy("location", "hospital").agg(F.count("*").alias("n"))
    return counts.groupBy("location").agg(F.min_by("hospital", F.struct(-F.col("n"), "hospital")).alias("hospital"))


def agenda(schedule: DataFrame, usage: DataFrame, places: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Scheduled demand per key and real day: cases times usage per case."""
    c = F.col
    ahead = schedule.withColumn("step", F.datediff(c("day"), F.lit(cfg.as_of))).filter((c("step") >= 1) & (c("step") <= cfg.horizon))
    booked = ahead.groupBy("hospital", "step").agg(F.sum("cases").alias("cases"))
    profile = usage.join(places, ["location", "hospital"])
    return profile.join(booked, "hospital").select(*KEYS, "step", (c("cases") * c("per_case")).alias("agenda"))


def with_agenda(forecast_rows: DataFrame, scheduled: DataFrame) -> DataFrame:
    """The schedule is a floor for its own day, never added on top of the forecast."""
    rows = forecast_rows.join(scheduled, [*KEYS, "step"], "left").withColumn("agenda", F.coalesce("agenda", F.lit(0.0)))
    return rows.withColumn("projected", F.greatest("forecast", "agenda"))


def project(openings: DataFrame, demand: DataFrame, events: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """One row per key with the balance's lowest point, first stockout, coverage and shortfall.

    openings: keys, opening, safety, window (days the shortfall looks at) · demand: keys, step, qty · events: keys, t, qty.
    Everything is one grouped sum per key and day followed by windows over at most horizon + 1 rows.
    """
    c = F.col
    zero = F.lit(0.0)
    steps = openings.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("t"), zero.alias("flow"), zero.alias("demand"))
    parts = (
        steps
        .unionByName(openings.select(*keys, F.lit(0).alias("t"), c("opening").alias("flow"), zero.alias("demand")))
        .unionByName(events.filter(c("t") <= horizon).select(*keys, F.greatest(c("t"), F.lit(0)).alias("t"), c("qty").alias("flow"), zero.alias("demand")))
        .unionByName(demand.filter(c("step") <= horizon).select(*keys, c("step").alias("t"), zero.alias("flow"), c("qty").alias("demand")))
    )
    days = parts.groupBy(*keys, "t").agg(F.sum("flow").alias("flow"), F.sum("demand").alias("demand"))
    order = Window.partitionBy(*keys).orderBy("t")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("balance", F.sum(c("flow") - c("demand")).over(running)).withColumn("before", F.lag("balance").over(order))
    rows = rows.join(openings.select(*keys, "safety", "window"), keys)
    out = c("balance") < -1e-9
    summary = rows.groupBy(*keys).agg(
        F.min("balance").alias("lowest"), F.max_by("balance", "t").alias("closing"), F.min(F.when(out, c("t"))).alias("stockout_day"),
        F.min(F.when(c("balance") < c("safety") - 1e-9, c("t"))).alias("below_safety_day"), F.sum("demand").alias("demand"),
        F.min_by(F.struct("before", "demand"), F.when(out, c("t"))).alias("at"), F.max("safety").alias("safety"),
        F.min(F.when(c("t") <= c("window"), c("balance"))).alias("lowest_in_window"))
    beyond = events.filter(c("t") > horizon).groupBy(*keys).agg(F.count("*").alias("events_beyond"))
    q = c("stockout_day")
    partial = (q - 1) + F.when(c("at.demand") > 0, c("at.before") / c("at.demand")).otherwise(0.0)
    coverage = (
        F.when(c("demand") <= 0, F.lit(None)).when(q.isNull(), float(horizon)).when(q == 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.round(partial, 2)))
    )
    return summary.join(beyond, keys, "left").select(
        *keys, "lowest", "closing", "stockout_day", "below_safety_day", coverage.alias("coverage"),
        F.greatest(F.lit(0.0), c("safety") - c("lowest")).alias("shortfall"),
        F.greatest(F.lit(0.0), c("safety") - c("lowest_in_window")).alias("window_shortfall"),
        F.when(q.isNotNull(), F.greatest(F.lit(1), q - 1)).alias("need_day"), F.coalesce("events_beyond", F.lit(0)).alias("events_beyond"))


def criticality(stockout: Column, below: Column, suggested: Column, daily: Column, lead: Column, cycle: int, stock: Column, excess_days: int) -> Column:
    """One rule for the base run and for scenarios; the order of the cases matters."""
    near = F.coalesce(stockout <= lead + cycle, F.lit(False)) | F.coalesce(below <= lead + cycle, F.lit(False))
    return (
        F.when(daily <= 0, "ok").when(stockout <= 1, "out_of_stock").when(stockout <= lead, "critical")
        .when((suggested > 0) & near, "reorder").when(stockout.isNull() & (stock / daily > excess_days), "excess").otherwise("ok")
    )
