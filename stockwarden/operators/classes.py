"""ABC by value, XYZ by variability, and first-expiry risk of lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.functions.dates import week_ending_sunday
from stockwarden.operators.quantiles import value_step
from stockwarden.operators.series import KEYS


def abc_xyz(lines: DataFrame, end: Column, days: int = 365, policies: dict[str, str] | None = None) -> DataFrame:
    """Value share over the last year and weekly variation; weeks without use inside a product's span count as zero.

    `policies` has the installation's text per class; a class without one is its own policy. The item that crosses 80 % is B. The running share is exact.
    """
    c = F.col
    recent = lines.withColumn("_end", end).filter(c("ts") > c("_end") - F.make_dt_interval(F.lit(days)))
    value = recent.groupBy("product_id").agg(F.min("product").alias("product"), F.sum("amount").alias("amount"))
    # Running shares without ordering all products in one task: totals by narrow steps of the amount run first (as many rows
    # as there are steps, whatever the number of products), then the products of each step on their own.
    value = value.withColumn("step", -value_step(c("amount")))
    steps = value.groupBy("step").agg(F.sum("amount").alias("of_step"))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumns({"before": F.coalesce(F.sum("of_step").over(upto), F.lit(0.0)), "whole": F.sum("of_step").over(Window.partitionBy())}).drop("of_step")
    inside = Window.partitionBy("step").orderBy(F.desc("amount"), "product_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = value.join(steps, value.step.eqNullSafe(steps.step)).drop(steps.step)
    share = lambda amount: F.coalesce(F.try_divide(amount, c("whole")), F.lit(0.0))
    ranked = ranked.withColumns({"share": share(c("amount")), "running": share(c("before") + F.sum("amount").over(inside))}).drop("step", "before", "whole")
    weeks = recent.groupBy("product_id", week_ending_sunday(c("ts")).alias("week")).agg(F.sum("qty").alias("q"))
    spread = weeks.groupBy("product_id").agg(
        (F.datediff(F.max("week"), F.min("week")) / 7 + 1).alias("n"), F.sum("q").alias("s"), F.stddev_pop("q").alias("sd"), F.count("*").alias("k"))
    mean, m_k = c("s") / c("n"), c("s") / c("k")
    # squared deviations of the used weeks around the full-span mean, plus one mean squared per empty week
    squares = c("k") * c("sd") * c("sd") + c("k") * (m_k - mean) * (m_k - mean) + (c("n") - c("k")) * mean * mean
    cv = F.when(c("n") > 1, F.try_divide(F.sqrt(squares / (c("n") - 1)), mean))
    rows = ranked.join(spread.select("product_id", cv.alias("cv")), "product_id", "left")
    abc = F.when(c("running") <= 0.80, "A").when(c("running") <= 0.95, "B").otherwise("C")
    xyz = F.when(F.round("cv", 2) < 0.5, "X").when(F.round("cv", 2) < 1.0, "Y").otherwise("Z")
    rows = rows.withColumns({"abc": abc, "xyz": xyz}).withColumn("class", F.concat("abc", "xyz"))
    named = [F.when(c("class") == k, v) for k, v in (policies or {}).items()]
    return rows.withColumn("policy", F.coalesce(*named, c("class")))


def expiry_risk(stock: DataFrame, local: DataFrame, cfg: SupplyConfig, horizon: int = 180) -> DataFrame:
    """First-expiry-first-out: what a lot keeps after earlier lots and the demand until it expires.

    Lots of one product at one location are few; expired lots still take their share of the running total.
    """
    c = F.col
    lots = stock.filter(c("expiry").isNotNull() & (c("qty") > 0)).join(local.select(*KEYS, "daily_demand"), KEYS, "left")
    costs = local.groupBy("product_id").agg(F.max("unit_cost").alias("unit_cost"))
    earlier = Window.partitionBy(*KEYS).orderBy("expiry", "lot").rowsBetween(Window.unboundedPreceding, -1)
    left = F.datediff(c("expiry").cast("date"), F.lit(cfg.as_of))
    rows = lots.join(costs, "product_id", "left").withColumns({
        "daily_demand": F.coalesce("daily_demand", F.lit(0.0)), "days_left": left, "earlier_qty": F.coalesce(F.sum("qty").over(earlier), F.lit(0.0))})
    usable = F.greatest(F.lit(0.0), c("daily_demand") * F.greatest(c("days_left"), F.lit(0)) - c("earlier_qty"))
    rows = rows.withColumn("at_risk", F.greatest(F.lit(0.0), c("qty") - usable)).filter((c("days_left") <= horizon) & ((c("at_risk") > 0) | (c("days_left") < 0)))
    status = F.when(c("days_left") < 0, "expired").when(c("days_left") <= 30, "critical").otherwise("risk")
    return rows.select(*KEYS, "lot", "expiry", "days_left", "qty", "daily_demand", "earlier_qty", "at_risk",
                       (c("at_risk") * F.coalesce("unit_cost", F.lit(0.0))).alias("at_risk_amount"), status.alias("status"))
