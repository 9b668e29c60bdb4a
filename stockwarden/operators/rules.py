"""Line rules. Each yields rows of the long hits table (line_id, method, points, expected, priority, reason)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig
from stockwarden.functions.text import present
from stockwarden.operators.profiles import SCOPES, Z_METHODS, product_bounds, scope_slots
from stockwarden.session import materialize

# Whose expectation wins when several rules state one (lowest first).
EXPECTED_PRIORITY = {
    "z_technician": 1,
    "z_doctor": 2,
    "z_hospital": 3,
    "z_product": 4,
    "R03_SCALE_MISMATCH": 5,
    "R04_NO_SURGERY": 6,
    "R06_CLINICAL_RATE": 7,
    "R08_DUPLICATE": 8,
}

HIT_COLUMNS = ("line_id", "method", "points", "expected", "priority", "reason")


def _hit(method: str, cfg: ConsumptionConfig, contrib: Column | float, reason: Column, expected: Column | None = None) -> Column:
    points = F.lit(cfg.weights.get(method, 1.0)) * (contrib if isinstance(contrib, Column) else F.lit(float(contrib)))
    stated = expected if expected is not None else F.lit(None)
    return F.struct(
        F.lit(method).alias("method"), points.cast("double").alias("points"), stated.cast("double").alias("expected"),
        F.lit(EXPECTED_PRIORITY.get(method, 99)).alias("priority"), reason.alias("reason"),
    )


def scale_columns(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """Scale reading against captured quantity. A weighing exists only with a start weight above zero."""
    weighed = F.col("weight_start").isNotNull() & F.col("weight_end").isNotNull() & (F.col("weight_start") > 0) & (F.col("qty") > 0)
    fallback = F.when(F.coalesce("weighable", F.lit(False)), 1.0).otherwise(cfg.default_density)
    density = F.coalesce("density", fallback)
    by_weight = (F.col("weight_start") - F.col("weight_end")) / density
    scale_ml = F.when(F.col("measured_ml") > 0, F.col("measured_ml")).otherwise(by_weight)
    rows = lines.withColumns({"weighed": weighed, "used_density": density})
    rows = rows.withColumn("scale_ml", F.when(F.col("weighed"), scale_ml))
    rows = rows.withColumn("scale_diff", F.col("scale_ml") - F.col("qty"))
    rows = rows.withColumn("scale_pct", F.when(F.col("weighed"), F.col("scale_diff") / F.col("qty")))
    impossible = F.col("weighed") & (F.col("weight_end") > F.col("weight_start") + cfg.scale_tolerance_g)
    off = (F.abs("scale_pct") > cfg.scale_tolerance_pct) & (
        F.abs("scale_diff") * F.col("used_density") > cfg.scale_tolerance_g * 2)
    return rows.withColumns({"scale_impossible": impossible,
                             "scale_mismatch": F.col("weighed") & ~impossible & F.coalesce(off, F.lit(False))})


def local_hits(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """R01–R06 and R09: each needs only its own line, so they run in the scan stage without a shuffle.

    `lines` carries `capacity` and `density` of its product and the product's median rate as `product_rate`.
    """
    c = F.col
    rows = scale_columns(lines, cfg)
    no_surgery = c("volatile") & (c("no_doctor") | ~F.coalesce(c("duration_min") > 0, F.lit(False)))
    odd_hours = c("volatile") & (c("night") | c("weekend"))
    hits = {
        "R01_OVER_CONTAINER": (
            c("volatile") & (c("qty") > c("capacity") * 1.02),
            1.0, F.format_string("quantity %.1f %s above a container of %.0f", c("qty"), c("unit"), c("capacity")), None),
        "R02_SCALE_IMPOSSIBLE": (
            c("scale_impossible"), 1.2,
            F.format_string("end weight %.1f g above start weight %.1f g", c("weight_end"), c("weight_start")), None),
        "R03_SCALE_MISMATCH": (
            c("scale_mismatch"), F.least(F.abs("scale_pct") / cfg.scale_tolerance_pct, F.lit(3.0)),
            F.format_string("scale: %.1f mL left the bottle against %.1f captured", c("scale_ml"), c("qty")),
            F.when(c("scale_diff") > 0, c("qty"))),
        "R04_NO_SURGERY": (no_surgery, 1.0, F.lit("volatile agent without doctor or surgery duration"), F.lit(0.0)),
        "R05_ODD_HOURS": (
            odd_hours, F.when(no_surgery, 1.0).otherwise(0.5),
            F.concat(F.lit("used "), F.when(c("night"), "at night").otherwise("on a weekend")), None),
        "R06_CLINICAL_RATE": (
            c("rate") > cfg.max_rate, F.least(c("rate") / cfg.max_rate, F.lit(3.0)),
            F.format_string("%.2f mL/min above the clinical ceiling of %.2f", c("rate"), F.lit(cfg.max_rate)),
            c("product_rate") * c("duration_min")),
        "R09_EXPIRED_LOT": (
            c("expiry") < c("ts"), 1.0, F.concat(F.lit("lot expired on "), F.date_format("expiry", "yyyy-MM-dd")), None),
    }
    found = [F.when(cond, _hit(method, cfg, contrib, reason, expected))
             for method, (cond, contrib, reason, expected) in hits.items() if method not in cfg.disabled_rules]
    return rows.select("line_id", F.explode(F.array(*found)).alias("h")).filter("h is not null").select("line_id", "h.*")


def z_hits(lines: DataFrame, cuts: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """Values far above their scope's median. Lines under every cut-off of their product never reach the shuffle.

    The bounds are one stored row per product: the planner knows their size before it plans the join with the lines.
    """
    c = F.col
    bounded = lines.join(materialize(product_bounds(cuts), "product-bounds"), "product_id").filter(
        (c("qty") >= c("qty_bound")) | (c("rate") >= c("rate_bound")))
    scopes = {s: SCOPES[s] for s in Z_METHODS}
    expanded = bounded.select("line_id", "product_id", "qty", "rate", "duration_min", F.explode(scope_slots(scopes)).alias("s")).filter("s is not null")
    judged = expanded.select("*", "s.scope", "s.entity").join(cuts, ["scope", "product_id", "entity"])
    judged = judged.withColumn("x", F.when(c("metric") == "rate", c("rate")).otherwise(c("qty")))
    judged = judged.withColumn("z", (c("x") - c("median")) / c("scale")).filter(
        (c("z") > c("threshold")) & (c("x") > c("p95")) & (c("x") - c("median") >= c("min_excess")))
    method = F.coalesce(*[F.when(c("scope") == s, m) for s, m in Z_METHODS.items()])
    weight = F.coalesce(*[F.when(c("method") == m, F.lit(cfg.weights[m])) for m in Z_METHODS.values()])
    priority = F.coalesce(*[F.when(c("method") == m, F.lit(EXPECTED_PRIORITY[m])) for m in Z_METHODS.values()])
    return judged.withColumn("method", method).filter(~c("method").isin(*cfg.disabled_rules) if cfg.disabled_rules else F.lit(True)).select(
        "line_id", "method", (weight * F.least(c("z") / c("threshold"), F.lit(3.0))).alias("points"),
        (c("median") * F.when(c("metric") == "rate", c("duration_min")).otherwise(1.0)).alias("expected"),
        priority.alias("priority"),
        F.format_string("%s %.2f against a median of %.2f (z=%.1f, n=%d)", "metric", "x", "median", "z", "n").alias("reason"),
    )


def lot_usage(lines: DataFrame) -> DataFrame:
    """Lines per (lot, hospital) with the lot's total, share and usual hospital."""
    used = lines.filter(present(F.col("lot")) & present(F.col("hospital"))).groupBy("lot", "hospital").agg(F.count("*").alias("n"))
    by_lot = Window.partitionBy("lot")
    return used.withColumns({
        "total": F.sum("n").over(by_lot),
        "usual_hospital": F.first("hospital").over(by_lot.orderBy(F.desc("n"), "hospital")),
    }).withColumn("share", F.col("n") / F.col("total"))


def travelling_lots(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """R07: a lot with a history, used a few times where it is not at home."""
    foreign = lot_usage(lines).filter((F.col("total") >= 15) & (F.col("share") < 0.10) & (F.col("n") <= 5))
    foreign = materialize(foreign.select("lot", "hospital", "usual_hospital"), "foreign-lots")  # few rows: the lines need no shuffle
    reason = F.concat_ws(" ", F.lit("lot"), "lot", F.lit("belongs to"), "usual_hospital", F.lit("and was used in"), "hospital")
    return lines.select("line_id", "lot", "hospital").join(foreign, ["lot", "hospital"]).select(
        "line_id", _hit("R07_TRAVELLING_LOT", cfg, 1.0, reason).alias("h")).select("line_id", "h.*")


def duplicates(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """R08: lines equal in case, product, quantity and time after the first.

    All lines are counted by a hash of these; only lines whose hash repeats are compared themselves. Groups are reduced to
    their first line before the join, so a group of many copies is one row on that side and its lines can be split over tasks.
    """
    same = ["case_no", "product_id", "qty", "ts"]
    lines = lines.select("line_id", *same).filter(" and ".join(f"{x} is not null" for x in same)).withColumn("same", F.xxhash64(*same))
    suspects = materialize(lines.groupBy("same").agg(F.count("*").alias("copies")).filter("copies > 1").select("same"), "repeated-hashes")
    lines = materialize(lines.join(suspects, "same", "left_semi"), "repeated-lines")
    repeated = lines.groupBy(*same).agg(F.min("line_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    extra = lines.select("line_id", *same).join(repeated, same).filter(F.col("line_id") > F.col("first_id"))
    return extra.select("line_id", _hit("R08_DUPLICATE", cfg, 1.0, F.lit("same as another line of the case"), F.lit(0.0)).alias("h")).select("line_id", "h.*")


def all_hits(lines: DataFrame, cuts: DataFrame, cfg: ConsumptionConfig, forest: DataFrame | None = None) -> DataFrame:
    parts = [local_hits(lines, cfg), z_hits(lines, cuts, cfg)]
    if "R07_TRAVELLING_LOT" not in cfg.disabled_rules:
        parts.append(travelling_lots(lines, cfg))
    if "R08_DUPLICATE" not in cfg.disabled_rules:
        parts.append(duplicates(lines, cfg))
    if forest is not None and "isolation_forest" not in cfg.disabled_rules:
        parts.append(forest)
    out = parts[0].select(*HIT_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*HIT_COLUMNS))
    return out


def scale_summary(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """Weighed lines, impossible readings, mismatches, grams unexplained and the median absolute difference."""
    from stockwarden.operators.quantiles import grouped_quantiles

    c = F.col
    rows = scale_columns(lines, cfg)
    sums = rows.agg(
        F.count_if("weighed").alias("weighed"), F.count_if("scale_impossible").alias("impossible"),
        F.count_if("scale_mismatch").alias("mismatches"),
        F.coalesce(F.sum(F.when(c("scale_mismatch") & (c("scale_diff") > 0), c("scale_diff") * c("used_density"))), F.lit(0.0)).alias("unexplained_g"),
    )
    off = rows.filter("weighed").select(F.lit(1).alias("one"), F.abs("scale_pct").alias("off"))
    median = grouped_quantiles(off, ["one"], "off", {"median_off": 0.5}).select((F.col("median_off") * 100).alias("median_pct"))
    return sums.withColumn("median_pct", median.scalar())
