"""History of consumption: trends, seasonality, comparisons and structural changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.functions.dates import month_key, week_ending_sunday
from stockwarden.functions.text import contains_text, present
from stockwarden.operators.features import is_volatile
from stockwarden.operators.patterns import days_before, last_moment


def monthly(lines: DataFrame) -> DataFrame:
    return lines.groupBy(month_key(F.col("ts")).alias("month")).agg(
        F.sum("amount").alias("amount"), F.count_distinct("case_no").alias("cases"), F.count("*").alias("lines"),
        F.coalesce(F.sum(F.when(is_volatile(), F.col("qty"))), F.lit(0.0)).alias("volatile_ml"))


def product_trends(lines: DataFrame) -> DataFrame:
    """Slope in % of the mean per month and last three against previous three complete months; four months or more.

    Windows run over the (product, month) table.
    """
    c = F.col
    months = lines.groupBy("product_id", month_key(c("ts")).alias("month")).agg(
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.min("product").alias("product"), F.max("ts").alias("last_ts"))
    by_product = Window.partitionBy("product_id")
    complete = months.withColumn("current", month_key(last_moment(lines))).filter("month < current")
    ordered = complete.withColumns({
        "x": F.row_number().over(by_product.orderBy("month")).cast("double"), "back": F.row_number().over(by_product.orderBy(F.desc("month")))})
    last3, prev3 = c("back") <= 3, (c("back") > 3) & (c("back") <= 6)
    out = ordered.groupBy("product_id").agg(
        F.min("product").alias("product"), F.count("*").alias("months"), F.regr_slope("qty", "x").alias("slope"), F.avg("qty").alias("mean"),
        F.avg(F.when(last3, c("qty"))).alias("last_3m"), F.avg(F.when(prev3, c("qty"))).alias("raw_prev"),
        F.sum(F.when(last3, c("amount"))).alias("amount_3m")).filter("months >= 4")
    previous = F.when(c("months") >= 6, c("raw_prev"))
    return out.select(
        "product_id", "product", "months", F.when(c("mean") != 0, 100 * c("slope") / c("mean")).otherwise(0.0).alias("trend_pct"), "last_3m",
        previous.alias("prev_3m"), F.when(previous != 0, 100 * (c("last_3m") / previous - 1)).alias("change_pct"), "amount_3m")


def hospital_comparison(lines: DataFrame, days: int = 30) -> DataFrame:
    """Last `days` against the `days` before, all hospitals in one pass."""
    c = F.col
    rows = lines.filter(present(c("hospital"))).withColumn("today", last_moment(lines))
    now = c("ts") > days_before(c("today"), days)
    before = ~now & (c("ts") > days_before(c("today"), 2 * days))
    out = rows.groupBy("hospital").agg(
        F.coalesce(F.sum(F.when(now, c("amount"))), F.lit(0.0)).alias("amount"), F.coalesce(F.sum(F.when(before, c("amount"))), F.lit(0.0)).alias("amount_prev"),
        F.count_distinct(F.when(now, c("case_no"))).alias("cases"), F.count_distinct(F.when(before, c("case_no"))).alias("cases_prev"))
    return out.select(
        "*", F.when(c("amount_prev") != 0, 100 * (c("amount") / c("amount_prev") - 1)).alias("change_pct"),
        F.when(c("cases") > 0, c("amount") / c("cases")).alias("amount_per_case"),
        F.when(c("cases_prev") > 0, c("amount_prev") / c("cases_prev")).alias("amount_per_case_prev"))


def volatile_or_all(lines: DataFrame) -> DataFrame:
    """Volatile lines; every line when the table has none."""
    some = lines.agg(F.coalesce(F.bool_or(is_volatile()), F.lit(False))).scalar()
    return lines.withColumn("_some", some).filter(is_volatile() | ~F.col("_some")).drop("_some")


def seasonality(lines: DataFrame) -> DataFrame:
    """Index per weekday and per calendar month: group sum over the mean of the sums."""
    parts = F.array(F.struct(F.lit("weekday").alias("kind"), F.weekday("ts").alias("slot")), F.struct(F.lit("month").alias("kind"), F.month("ts").alias("slot")))
    sums = volatile_or_all(lines).select("qty", F.explode(parts).alias("p")).groupBy("p.kind", "p.slot").agg(F.sum("qty").alias("qty"))
    return sums.select("kind", "slot", (F.col("qty") / F.avg("qty").over(Window.partitionBy("kind"))).alias("index"))


def year_over_year(lines: DataFrame, last: int = 6) -> DataFrame:
    """The last months against the same month a year before; only with thirteen months or more."""
    c = F.col
    months = lines.groupBy(F.trunc("ts", "month").alias("first_day")).agg(F.sum("amount").alias("amount"))
    placed = months.withColumns({"n": F.count("*").over(Window.partitionBy()), "back": F.row_number().over(Window.orderBy(F.desc("first_day")))})
    before = months.select(F.add_months("first_day", 12).alias("first_day"), c("amount").alias("amount_prev"))
    return placed.filter((c("n") >= 13) & (c("back") <= last)).join(before, "first_day").filter("amount_prev <> 0").select(
        month_key(c("first_day")).alias("month"), "amount", "amount_prev", (100 * (c("amount") / c("amount_prev") - 1)).alias("change_pct"))


def structural_changes(lines: DataFrame, alarm: float = 5.0) -> DataFrame:
    """One-sided CUSUM over each hospital's non-zero weeks, baseline = mean and sd of the first half (six weeks at least).

    With P the running sum of (x - mean)/sd - 0.5 the statistic is P minus the lowest P so far (zero included), so
    two window sums replace the recursion. Weeks per hospital are few.
    """
    c = F.col
    weekly = volatile_or_all(lines).groupBy("hospital", week_ending_sunday(c("ts")).alias("week")).agg(F.sum("qty").alias("x")).filter("x > 0")
    hospital = Window.partitionBy("hospital")
    in_order = hospital.orderBy("week")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = weekly.withColumns({"i": F.row_number().over(in_order), "n": F.count("*").over(hospital)}).filter("n >= 12")
    first = c("i") <= F.greatest(F.lit(6), F.floor(c("n") / 2))
    rows = rows.withColumns({"mu": F.avg(F.when(first, c("x"))).over(hospital), "sd": F.stddev_pop(F.when(first, c("x"))).over(hospital)})
    rows = rows.withColumn("p", F.sum((c("x") - c("mu")) / F.when(c("sd") > 0, c("sd")).otherwise(1.0) - 0.5).over(upto))
    rows = rows.withColumn("s", c("p") - F.least(F.lit(0.0), F.min("p").over(upto)))
    peak = rows.withColumns({"top": F.max("s").over(hospital)}).withColumn("at", F.min(F.when(c("s") == c("top"), c("i"))).over(hospital))
    return peak.filter(c("top") > alarm).groupBy("hospital").agg(
        F.min(F.when(c("i") == c("at"), c("week"))).alias("week"), F.max("top").alias("cusum"), F.max("mu").alias("level_before"),
        F.avg(F.when(c("i") >= c("at"), c("x"))).alias("level_after"))


def demand_history(lines: DataFrame) -> dict[str, DataFrame]:
    """Monthly money and cases, monthly quantity by unit and weekly money of the last 26 weeks."""
    month = month_key(F.col("ts")).alias("month")
    weeks = lines.groupBy(week_ending_sunday(F.col("ts")).alias("week")).agg(F.sum("amount").alias("amount"))
    return {
        "monthly": lines.groupBy(month).agg(F.sum("amount").alias("amount"), F.count_distinct("case_no").alias("cases")),
        "monthly_by_unit": lines.groupBy(month, "unit").agg(F.sum("qty").alias("qty"), F.sum("amount").alias("amount")),
        "last_26_weeks": weeks.orderBy(F.desc("week")).limit(26),
    }


def growth(lines: DataFrame, end: Column, days: int = 90) -> DataFrame:
    """Quantity of the last `days` against the `days` before, for products used in the last ones."""
    c = F.col
    rows = lines.withColumn("end", end)
    now = c("ts") > days_before(c("end"), days)
    before = ~now & (c("ts") > days_before(c("end"), 2 * days))
    out = rows.groupBy("product_id", "product", "unit").agg(
        F.sum(F.when(now, c("qty"))).alias("last"), F.coalesce(F.sum(F.when(before, c("qty"))), F.lit(0.0)).alias("previous"))
    return out.filter(c("last").isNotNull()).select(
        "*", F.when(c("previous") != 0, 100 * (c("last") / c("previous") - 1)).alias("change_pct"))


def product_weeks(lines: DataFrame, product: str, place: str = "", weeks: int = 12) -> DataFrame:
    """Weekly quantities of a product (weeks without use count as zero), the last ones, with their trend label."""
    c = F.col
    rows = lines.filter(contains_text(product, c("product")))
    if place:
        rows = rows.filter(contains_text(place, c("sublocation"), c("warehouse")))
    used = rows.groupBy(week_ending_sunday(c("ts")).alias("week")).agg(F.sum("qty").alias("qty"))
    span = used.agg(F.max("week").alias("to"), F.min("week").alias("from"))
    first = F.greatest(c("from"), F.date_sub(c("to"), 7 * (weeks - 1)))
    dense = span.select(F.explode(F.sequence(first, c("to"), F.expr("interval 7 days"))).alias("week"))
    series = dense.join(used, "week", "left").withColumn("qty", F.coalesce("qty", F.lit(0.0)))
    everything = Window.partitionBy()
    placed = series.withColumns({
        "i": F.row_number().over(Window.orderBy("week")), "n": F.count("*").over(everything)})
    head, tail = F.avg(F.when(c("i") <= 4, c("qty"))).over(everything), F.avg(F.when(c("i") > c("n") - 4, c("qty"))).over(everything)
    trend = F.when((c("n") > 4) & (tail > head * 1.15), "up").when((c("n") > 4) & (tail < head * 0.85), "down").otherwise("stable")
    return placed.select("week", "qty", F.avg("qty").over(everything).alias("mean"), trend.alias("trend"))


def typical_cases(lines: DataFrame, since: Column | None = None) -> DataFrame:
    """Median of daily distinct cases per hospital; days per hospital are few."""
    rows = lines if since is None else lines.withColumn("_since", since).filter(F.col("ts") > F.col("_since"))
    daily = rows.groupBy("hospital", F.col("ts").cast("date").alias("day")).agg(F.count_distinct("case_no").alias("cases"))
    return daily.groupBy("hospital").agg(F.percentile("cases", 0.5).alias("typical"))


def scheduled_load(schedule: DataFrame, typical: DataFrame) -> DataFrame:
    """Scheduled cases per day against the typical day."""
    c = F.col
    load = schedule.groupBy("hospital").agg(F.sum("cases").alias("cases"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"))
    per_day = c("cases") / F.greatest(c("days"), F.lit(1))
    return load.join(typical, "hospital", "left").select(
        "hospital", "cases", "days", "first_day", per_day.alias("per_day"), F.coalesce("typical", F.lit(0.0)).alias("typical"),
        F.when(c("typical") > 0, per_day / c("typical")).alias("ratio"))
