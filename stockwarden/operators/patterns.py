"""Sustained patterns: level shifts, actors away from their peers, extreme days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig
from stockwarden.functions.text import present
from stockwarden.operators import sieve
from stockwarden.operators.quantiles import grouped_quantiles
from stockwarden.session import materialize

COLUMNS = (
    "rule", "severity", "product_id", "product", "dimension", "key", "hospital", "actor", "recent_value", "base_value", "ratio",
    "n_recent", "n_base", "window_days", "risk_amount", "score", "reason",
)


def last_moment(lines: DataFrame) -> Column:
    return lines.agg(F.max("ts")).scalar()


def days_before(moment: Column, days: int) -> Column:
    return moment - F.make_dt_interval(F.lit(days))


def place_dimension(lines: DataFrame) -> Column:
    """Sublocation when more than half of the lines name one, else hospital."""
    filled = lines.agg(F.count_if(present(F.col("sublocation"))) / F.count("*")).scalar()
    return F.when(filled > 0.5, "sublocation").otherwise("hospital")


def _marked(lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """Lines with `fresh` = not already a finding of its own."""
    rows = sieve.may_match(lines, sieve.bitmap(flagged, "line_id"), "line_id", "_near")
    joined = rows.filter("_near").drop("_near").join(flagged.select("line_id", F.lit(True).alias("_f")), "line_id", "left")
    clear = rows.filter("not _near").drop("_near").withColumn("fresh", F.lit(True))
    return joined.withColumn("fresh", F.col("_f").isNull()).drop("_f").unionByName(clear)


def level_shifts(lines: DataFrame, flagged: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """R10: recent level per product and place against the base before it, for one and two recent windows."""
    c = F.col
    bounded = lines.select("line_id", "ts", "product_id", "product", "hospital", "sublocation", "qty", "amount", "rate").withColumns(
        {"today": last_moment(lines), "dimension": place_dimension(lines)})
    longest = 2 * cfg.recent_days + cfg.base_days
    bounded = bounded.filter(c("ts") > c("today") - F.make_dt_interval(F.lit(longest)))
    bounded = bounded.withColumn("key", F.when(c("dimension") == "sublocation", c("sublocation")).otherwise(c("hospital")))
    # Both windows are cut from the same sums: a line's part in them is four bits, and lines are summed once by key, bits and rate.
    spans = (cfg.recent_days, 2 * cfg.recent_days)
    after = lambda days: c("ts") > c("today") - F.make_dt_interval(F.lit(days))
    bits = sum((F.when(cond, 1 << n).otherwise(0) for n, cond in enumerate(x for d in spans for x in (after(d), after(d + cfg.base_days)))), F.lit(0))
    place = ["product_id", "key", "dimension"]
    # Names are keys until there are few rows: a minimum of text is sorted, not hashed.
    names = ["product", "hospital"]
    summed = _marked(bounded, flagged).groupBy(*place, *names, bits.alias("bits"), "rate").agg(
        F.count("*").alias("n"), F.count("qty").alias("n_qty"), F.sum("qty").alias("qty"), F.sum("amount").alias("amount"), F.sum(F.when(c("fresh"), c("qty"))).alias("fresh"))
    summed = materialize(summed, "level-sums")
    part = lambda k, d: F.struct(F.lit(d).alias("window_days"), (c("bits").bitwiseAND(1 << 2 * k) > 0).alias("recent"), (c("bits").bitwiseAND(2 << 2 * k) > 0).alias("inside"))
    staged = summed.withColumn("w", F.explode(F.filter(F.array(*[part(k, d) for k, d in enumerate(spans)]), lambda w: w["inside"]))).select(*summed.columns, "w.window_days", "w.recent")
    keys = [*place, "window_days"]
    medians = grouped_quantiles(staged, [*keys, "recent"], "rate", {"m": 0.5}, "n")
    medians = medians.groupBy(*keys).agg(F.max(F.when(c("recent"), c("m"))).alias("rate_recent"), F.max(F.when(~c("recent"), c("m"))).alias("rate_base"))
    r, b = c("recent"), ~c("recent")
    total = lambda cond, x: F.sum(F.when(cond, c(x)))
    many = lambda cond, x: F.coalesce(total(cond, x), F.lit(0))
    parts = staged.groupBy(*keys, "recent", *names).agg(
        *[F.sum(x).alias(x) for x in ("n", "n_qty", "qty", "amount", "fresh")], F.sum(F.when(c("rate").isNotNull(), c("n"))).alias("n_rate"))
    sums = parts.groupBy(*keys).agg(
        many(r, "n").alias("lines_recent"), many(b, "n").alias("lines_base"), many(r, "n_rate").alias("rates_recent"), many(b, "n_rate").alias("rates_base"),
        (total(r, "qty") / F.nullif(total(r, "n_qty"), F.lit(0))).alias("qty_recent"), (total(b, "qty") / F.nullif(total(b, "n_qty"), F.lit(0))).alias("qty_base"),
        total(r, "amount").alias("amount"), total(r, "qty").alias("qty"), F.coalesce(total(r, "fresh"), F.lit(0.0)).alias("fresh_qty"),
        F.min(F.when(r, c("product"))).alias("product"), F.min(F.when(r, c("hospital"))).alias("hospital"),
    )
    by_rate = (c("rates_recent") >= 6) & (c("rates_base") >= 10)
    rows = sums.join(medians, keys, "left").withColumns({
        "recent_value": F.when(by_rate, c("rate_recent")).otherwise(c("qty_recent")),
        "base_value": F.when(by_rate, c("rate_base")).otherwise(c("qty_base")),
        "n_recent": F.when(by_rate, c("rates_recent")).otherwise(c("lines_recent")),
        "n_base": F.when(by_rate, c("rates_base")).otherwise(c("lines_base")),
        "min_change": F.when(by_rate, 0.0).otherwise(F.greatest(F.lit(1.0), 0.25 * c("qty_base"))),
    })
    rows = rows.filter((c("n_recent") >= 6) & (c("n_base") >= 10) & (c("base_value") > 0)).withColumn("raw", c("recent_value") / c("base_value"))
    rows = rows.filter((c("raw") >= cfg.level_ratio) & (c("recent_value") - c("base_value") >= c("min_change")))
    rows = rows.withColumn("score", F.round(F.least(F.lit(10.0), 3 * c("raw")), 2))
    cost = F.when(c("qty") != 0, c("amount") / c("qty")).otherwise(0.0)
    shaped = rows.select(
        F.lit("R10_LEVEL_SHIFT").alias("rule"), F.when(c("raw") < 2, "high").otherwise("critical").alias("severity"), "product_id", "product",
        "dimension", "key", "hospital", F.lit("").alias("actor"), "recent_value", "base_value", c("raw").alias("ratio"), "n_recent", "n_base",
        "window_days", (c("fresh_qty") * (1 - c("base_value") / c("recent_value")) * cost).alias("risk_amount"), "score",
        F.format_string("level of %s at %s went from %.3f to %.3f (x%.2f) in the last %d days", "product", "key", "base_value", "recent_value", "raw",
                        "window_days").alias("reason"),
    )
    strength = F.struct(c("score") * F.sqrt("n_recent"), -c("window_days"))
    best = shaped.groupBy("product_id", "key").agg(F.max_by(F.struct(*COLUMNS), strength).alias("p"))
    return best.select("p.*")


def _peer_median(value: Column, group: Window, rank: Column, size: Column) -> Column:
    """Median of the group's other values, from the ordered values themselves: no pairs are formed."""
    low, high = F.floor((size - 2) / 2), F.floor((size - 1) / 2)

    def at(position: Column) -> Column:
        # position among the others -> position in the whole group, which skips the own rank
        return F.when(position < rank, position).otherwise(position + 1)

    middle = {j: F.max(F.when(rank == low + j, value)).over(group) for j in (0, 1, 2)}

    def value_at(position: Column) -> Column:
        return F.coalesce(*[F.when(at(position) == low + j, middle[j]) for j in (0, 1, 2)])

    return (value_at(low) + value_at(high)) / 2


def actor_deviations(lines: DataFrame, flagged: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """R11: an actor whose usual rate is above the median of their peers' for the same product and hospital."""
    c = F.col
    recent = lines.filter(c("rate").isNotNull()).withColumn("today", last_moment(lines)).filter(
        c("ts") > days_before(c("today"), cfg.recent_days))
    actors = F.array_compact(F.array(*[
        F.when(present(c(a)), F.struct(F.lit(a).alias("dimension"), c(a).alias("actor"))) for a in ("technician", "doctor")]))
    staged = _marked(recent.select("line_id", "product_id", "product", "hospital", "qty", "amount", "rate", "technician", "doctor"), flagged)
    staged = staged.select("*", F.explode(actors).alias("a")).select("product_id", "product", "hospital", "qty", "amount", "rate", "fresh", "a.*")
    keys = ["product_id", "hospital", "dimension", "actor"]
    # Lines are joined and expanded once; all that follows reads these sums.
    summed = materialize(staged.groupBy(*keys, "product", "rate").agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"), F.sum("qty").alias("qty"), F.sum(F.when(c("fresh"), c("qty"))).alias("fresh")), "actor-sums")
    rates = grouped_quantiles(summed, keys, "rate", {"median": 0.5, "p25": 0.25}, "n")
    parts = summed.groupBy(*keys, "product").agg(*[F.sum(x).alias(x) for x in ("n", "amount", "qty", "fresh")])
    sums = parts.groupBy(*keys).agg(
        *[F.sum(x).alias(x) for x in ("n", "amount", "qty")], F.min("product").alias("product"), F.coalesce(F.sum("fresh"), F.lit(0.0)).alias("fresh_qty"))
    group = Window.partitionBy("product_id", "hospital", "dimension")
    rows = rates.withColumns({"rank": F.row_number().over(group.orderBy("median", "actor")) - 1, "size": F.count("*").over(group)})
    rows = rows.withColumn("peers", _peer_median(c("median"), group, c("rank"), c("size"))).filter(c("size") >= 2)
    rows = rows.join(sums, keys).filter((c("n") >= 10) & (c("peers") > 0)).withColumn("raw", c("median") / c("peers"))
    rows = rows.filter((c("raw") >= cfg.actor_ratio) & (c("p25") > c("peers")))
    cost = F.when(c("qty") != 0, c("amount") / c("qty")).otherwise(0.0)
    return rows.select(
        F.lit("R11_ACTOR_DEVIATION").alias("rule"), F.when(c("raw") >= 1.4, "critical").otherwise("high").alias("severity"), "product_id", "product",
        "dimension", c("actor").alias("key"), "hospital", "actor", c("median").alias("recent_value"), c("peers").alias("base_value"),
        c("raw").alias("ratio"), c("n").alias("n_recent"), (c("size") - 1).alias("n_base"), F.lit(cfg.recent_days).alias("window_days"),
        (c("fresh_qty") * (1 - c("peers") / c("median")) * cost).alias("risk_amount"),
        F.round(F.least(F.lit(10.0), 4 * c("raw")), 2).alias("score"),
        F.format_string("%s uses %.3f mL/min of %s against %.3f of the peers in %s (x%.2f)", "actor", "median", "product", "peers", "hospital",
                        "raw").alias("reason"),
    )


def extreme_days(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """R12: days with many more cases than the technician's 95th percentile. Days per technician are few."""
    c = F.col
    named = lines.filter(present(c("technician")))
    daily = named.groupBy("technician", "day").agg(F.count_distinct("case_no").alias("cases"))
    # Counted, not distinct: below a minimum Spark would drop the latter and sort all lines.
    places = named.groupBy("technician", "hospital").agg(F.count("*").alias("n")).filter("n > 0")
    places = places.groupBy("technician").agg(F.min("hospital").alias("hospital"))
    limits = daily.groupBy("technician").agg(F.percentile("cases", 0.95).alias("p95")).join(places, "technician")
    rows = daily.join(limits, "technician").withColumn("today", last_moment(lines))
    rows = rows.filter((c("cases") > F.greatest(F.lit(3.0), c("p95") * 1.5)) & (c("day").cast("timestamp_ntz") > days_before(c("today"), cfg.recent_days)))
    return rows.select(
        F.lit("R12_CASE_FREQUENCY").alias("rule"), F.lit("medium").alias("severity"), F.lit(None).cast("bigint").alias("product_id"), F.lit("").alias("product"),
        F.lit("technician").alias("dimension"), c("technician").alias("key"), "hospital", c("technician").alias("actor"),
        c("cases").cast("double").alias("recent_value"), c("p95").alias("base_value"), (c("cases") / F.greatest(F.lit(1.0), c("p95"))).alias("ratio"),
        F.lit(1).cast("bigint").alias("n_recent"), F.lit(0).cast("bigint").alias("n_base"), F.lit(cfg.recent_days).alias("window_days"),
        F.lit(0.0).alias("risk_amount"), F.lit(2.0).alias("score"),
        F.format_string("%s had %d cases on %s (p95 is %.0f)", "technician", "cases", c("day").cast("string"), "p95").alias("reason"),
    )


def all_patterns(lines: DataFrame, flagged: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    return level_shifts(lines, flagged, cfg).unionByName(actor_deviations(lines, flagged, cfg)).unionByName(extreme_days(lines, cfg))
