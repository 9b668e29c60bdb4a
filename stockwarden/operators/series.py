"""Daily demand series per product and location, one row per key with its values in calendar order."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.functions.text import present
from stockwarden.session import materialize

KEYS = ["product_id", "location"]


def choose_dimension(lines: DataFrame, wanted: str) -> str:
    """The wanted dimension when over half of the lines name it, else the warehouse, else the hospital."""
    columns = [c for c in (wanted, "warehouse") if c in lines.columns]
    shares = lines.agg(*[(F.count_if(present(F.col(c))) / F.count("*")).alias(c) for c in columns]).first()
    return next((c for c in columns if (shares[c] or 0) > 0.5), "hospital")


def located(lines: DataFrame, dimension: str) -> DataFrame:
    place = F.trim(dimension)
    return lines.filter(F.col("ts").isNotNull() & present(F.col(dimension))).withColumn("location", place)


def calendar(lines: DataFrame, cfg: SupplyConfig) -> tuple[date, date]:
    """First and last day of every series: the history up to the last data, at least the minimum length."""
    row = lines.agg(F.min("ts").cast("date").alias("first"), F.max("ts").cast("date").alias("last")).first()
    end = min(cfg.as_of, row["last"])
    days = max(min(cfg.history_days, (end - row["first"]).days + 1), cfg.min_history)
    return end - timedelta(days=days - 1), end


def capture_gaps(lines: DataFrame, threshold: float) -> DataFrame:
    """Working days inside a location's span on which the network worked and it recorded nothing, if they are few.

    The arrays hold calendar days, so their size is bounded by the calendar, not by the lines.
    """
    days = materialize(lines.select("location", F.col("ts").cast("date").alias("day")).distinct(), "location-days")
    network = days.filter(F.weekday("day") < 5).agg(F.array_sort(F.collect_set("day"))).scalar()
    own = days.groupBy("location").agg(F.collect_set("day").alias("own"), F.min("day").alias("first"), F.max("day").alias("last"))
    inside = own.withColumn("network", network).withColumn(
        "open_days", F.filter("network", lambda d: (d >= F.col("first")) & (d <= F.col("last"))))
    missing = inside.withColumn("gaps", F.array_except("open_days", "own")).filter(F.size("gaps") > 0)
    return missing.filter(F.size("gaps") / F.size("open_days") <= threshold).select("location", F.array_sort("gaps").alias("gaps"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _median(values: Column) -> Column:
    """Median of an array that is not empty."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def daily_series(lines: DataFrame, cfg: SupplyConfig, gaps: DataFrame | None = None) -> DataFrame:
    """Zero-filled daily quantities on the calendar; capture-gap days take the median of their weekday.

    Lines are summed per key and day before the shuffle by key, and a key is one row of at most `history_days` values.
    """
    start, end = calendar(lines, cfg)
    length = (end - start).days + 1
    c = F.col
    day = c("ts").cast("date")
    # Names are keys until there are few rows: a minimum of text is sorted, not hashed.
    named = lines.groupBy(*KEYS, day.alias("day"), "product", "unit").agg(F.sum("qty").alias("qty"), F.count("*").alias("lines"))
    daily = named.groupBy(*KEYS, "day").agg(
        F.sum("qty").alias("qty"), F.sum("lines").alias("lines"), F.min("product").alias("product"), F.min("unit").alias("unit"))
    inside = (c("day") >= F.lit(start)) & (c("day") <= F.lit(end))
    offset = F.datediff(c("day"), F.lit(start))
    keyed = daily.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.when(inside, F.struct(offset.alias("o"), c("qty").alias("q"))))).alias("e"),
        F.sum("lines").alias("lines"), F.min("product").alias("product"), F.min("unit").alias("unit"), F.max("day").alias("last_used"))

    def with_zeros(entry: Column, i: Column) -> Column:
        following = F.coalesce(F.get(c("e"), i + 1)["o"], F.lit(length))
        return F.concat(F.array(entry["q"]), F.array_repeat(F.lit(0.0), following - entry["o"] - 1))

    leading = F.coalesce(F.get(c("e"), F.lit(0))["o"], F.lit(length))
    dense = keyed.withColumn("y", F.concat(F.array_repeat(F.lit(0.0), leading), F.flatten(F.transform("e", with_zeros)))).drop("e")
    if gaps is None:
        return dense.withColumns({"imputed": F.lit(0), "start": F.lit(start)})
    with_gaps = dense.join(gaps, "location", "left").withColumn(
        "g", F.filter(F.transform(F.coalesce("gaps", F.array().cast("array<date>")), lambda d: F.datediff(d, F.lit(start))), lambda o: (o >= 0) & (o < length)))
    weekday0 = start.weekday()

    def weekday_median(w: Column) -> Column:
        values = F.filter(c("y"), lambda v, i: ((i + weekday0) % 7 == w) & ~F.array_contains(c("g"), i))
        return F.when(F.size(values) > 0, _median(values)).otherwise(0.0)

    typical = with_gaps.withColumn("typical", F.when(F.size("g") > 0, F.transform(F.sequence(F.lit(0), F.lit(6)), weekday_median)))
    filled = F.transform("y", lambda v, i: F.when(F.array_contains(c("g"), i), F.get(c("typical"), (i + weekday0) % 7)).otherwise(v))
    return typical.withColumn("y", F.when(F.size("g") > 0, filled).otherwise(c("y"))).withColumns(
        {"imputed": F.size("g"), "start": F.lit(start)}).drop("g", "gaps", "typical")


def describe_series(series: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Leading zeros trimmed when enough history remains, and the flags that choose the methods."""
    c = F.col
    first = F.coalesce(F.nullif(F.array_position(F.transform("y", lambda v: v > 0), True), F.lit(0)) - 1, F.lit(0)).cast("int")
    rows = series.withColumns({"demand_days": F.size(F.filter("y", lambda v: v > 0)), "first": first})
    trimmed = F.when(F.size("y") - c("first") >= cfg.min_history, F.slice("y", c("first") + 1, F.size("y"))).otherwise(c("y"))
    rows = rows.withColumn("y", trimmed).withColumns({
        "n": F.size("y"), "zero_share": F.size(F.filter("y", lambda v: v == 0)) / F.size("y"),
        "total": F.aggregate("y", F.lit(0.0), lambda a, v: a + v)})
    tail = lambda k, skip=0: F.aggregate(F.slice("y", F.greatest(c("n") - (k + skip) + 1, F.lit(1)), F.least(F.lit(k), c("n"))), F.lit(0.0), lambda a, v: a + v)
    return rows.withColumns({
        "insufficient": (c("n") < cfg.min_history) | (c("demand_days") < cfg.min_demand_days) | (c("total") <= 0),
        "intermittent": c("zero_share") > 0.6,
        "last_28d": tail(28),
        "prev_28d": F.when(c("n") >= 56, tail(28, 28)),
    }).drop("first", "total")
