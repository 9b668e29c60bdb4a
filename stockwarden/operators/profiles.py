"""Robust profiles of consumption per scope, and the cut-offs line scores are judged by."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig
from stockwarden.functions.text import present
from stockwarden.operators.quantiles import quantiles_of_counts
from stockwarden.session import materialize

# scope -> the second key column (None: the product alone)
SCOPES = {
    "product": None,
    "product_hospital": "hospital",
    "product_doctor": "doctor",
    "product_technician": "technician",
    "product_sublocation": "sublocation",
}

Z_METHODS = {
    "product": "z_product",
    "product_hospital": "z_hospital",
    "product_doctor": "z_doctor",
    "product_technician": "z_technician",
}


def scope_slots(scopes: dict[str, str | None]) -> Column:
    """Array of a (scope, entity) for every scope, null where the entity is blank."""
    return F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit("").alias("entity")) if column is None
        else F.when(present(F.col(column)), F.struct(F.lit(scope).alias("scope"), F.col(column).alias("entity")))
        for scope, column in scopes.items()
    ])


#: The columns that hold the entities of a scope.
SCOPES_READ = [column for column in SCOPES.values() if column is not None]

PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}

#: Groups of at most so many distinct values are ordered by one sort; the choice only changes the way, both are exact.
SORTED_VALUES = 2_000


def _squares() -> Column:
    return F.sqrt(F.sum(F.col("k") * F.pow(F.col("value") - F.col("mean"), 2)) / (F.sum("k") - 1)).alias("sd")


def _few_values(values: DataFrame) -> DataFrame:
    """Quantiles, MAD and sd of groups of at most `SORTED_VALUES` values: one shuffle by group, two sorts in it."""
    c, group = F.col, Window.partitionBy("group")

    def picked(value: str, start: str, probs: dict[str, float], reduce) -> dict[str, Column]:
        found = {}
        for name, p in probs.items():
            at = F.lit(p) * (c("total") - 1)
            lo, hi = [reduce(F.when((c(start) <= r) & (r < c(start) + c("k")), c(value))) for r in (F.floor(at), F.ceil(at))]
            found[name] = lo, hi
        return found

    def blended(p: float, lo: Column, hi: Column) -> Column:
        at = F.lit(p) * (c("total") - 1)
        return lo + (hi - lo) * (at - F.floor(at))

    def started(order: str) -> Column:
        return F.coalesce(F.sum("k").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    rows = values.withColumn("start", started("value"))
    middle = picked("value", "start", {"median": 0.5}, lambda x: F.max(x).over(group))["median"]
    rows = rows.withColumns({"lo": middle[0], "hi": middle[1]})
    rows = rows.withColumn("deviation", F.abs(c("value") - blended(0.5, c("lo"), c("hi")))).drop("lo", "hi")
    rows = rows.withColumn("far", started("deviation"))
    ends = picked("value", "start", PROBS, F.max) | picked("deviation", "far", {"mad": 0.5}, F.max)
    named = [x.alias(f"{name}_{side}") for name, pair in ends.items() for side, x in zip(("lo", "hi"), pair, strict=True)]
    found = rows.groupBy("group", "total").agg(*named, _squares())
    return found.select("group", *[blended(p, c(f"{name}_lo"), c(f"{name}_hi")).alias(name) for name, p in (PROBS | {"mad": 0.5}).items()], "sd")


def _many_values(values: DataFrame) -> DataFrame:
    """The same of groups of any size, none of which is gathered in a task."""
    centres = materialize(quantiles_of_counts(values.select("group", "value", F.col("k").alias("n")), ["group"], "value", PROBS).drop("total"), "profile-centres")
    deviations = values.join(centres.select("group", "median"), "group").groupBy("group", F.abs(F.col("value") - F.col("median")).alias("deviation")).agg(F.sum("k").alias("n"))
    mads = quantiles_of_counts(deviations, ["group"], "deviation", {"mad": 0.5}).select("group", "mad")
    return centres.join(mads, "group").join(values.groupBy("group").agg(_squares()), "group").select("group", *PROBS, "mad", "sd")


def profile_key(product_id: Column, entity: Column) -> Column:
    return F.when(entity == "", product_id.cast("string")).otherwise(F.concat_ws("|", product_id, entity))


def build_profiles(lines: DataFrame) -> DataFrame:
    """n, mean, median, MAD, sd, percentiles and range of positive quantities and rates, at least 3 values each.

    Every line is expanded to its scopes and metrics, then counted per distinct value with map-side combine. The
    counts are stored once; all statistics come from them.
    """
    metrics = F.array(*[F.when(F.col(m) > 0, F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))) for m in ("qty", "rate")])
    keys = ["scope", "product_id", "entity", "metric"]
    long = (
        lines.filter(F.col("product_id").isNotNull())
        .select("product_id", "product", "unit", *SCOPES_READ, F.explode(metrics).alias("m")).filter("m is not null")
        .select("product_id", "product", "unit", "m.metric", "m.value", F.explode(scope_slots(SCOPES)).alias("s")).filter("s is not null")
        .select("s.scope", "product_id", "s.entity", "metric", "value", F.col("product").alias("label"), "unit")
    )
    # A minimum of text is sorted, not hashed: names and units are keys until there are few rows.
    counts = materialize(long.groupBy(*keys, "label", "unit", "value").agg(F.count("*").alias("n")), "profile-counts")
    first = counts.groupBy(*keys, "label", "unit").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("*").alias("values"),
    ).groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("label").alias("label"), F.min("unit").alias("unit"), F.sum("values").alias("values"),
    ).filter("n >= 3")
    # Groups get a number once (they are stored, so they keep it): from here on rows are a number, a value and a count.
    first = materialize(first.withColumn("group", F.monotonically_increasing_id()), "profile-groups")
    values = counts.select(*keys, "value", F.col("n").alias("k")).join(first.select(*keys, "group", "mean", "values", F.col("n").alias("total")), keys)
    values = materialize(values.select("group", "mean", "value", "k", "values", "total"), "profile-values")
    spread = _few_values(values.filter(F.col("values") <= SORTED_VALUES)).unionByName(_many_values(values.filter(F.col("values") > SORTED_VALUES)))
    return first.join(spread, "group").select(
        "scope", profile_key(F.col("product_id"), F.col("entity")).alias("key"), "metric", "product_id", "entity", "label", "n",
        "mean", "median", "mad", "sd", "p05", "p25", "p75", "p95", "min", "max",
        F.when(F.col("metric") == "rate", "mL/min").otherwise(F.col("unit")).alias("unit"),
    )


def _scope_groups(lines: DataFrame, scopes: dict[str, str | None], sums: dict[str, Column]) -> DataFrame:
    """`sums` by scope, product and entity as grouping sets: no structs are built a line, blank entities drop out as groups."""
    columns = [column for column in scopes.values() if column is not None]
    keys = ["product_id", *columns]
    # The bits of the keys a set leaves out, the first key highest.
    number = {scope: sum(1 << len(keys) - 1 - n for n, key in enumerate(keys) if key not in ("product_id", column)) for scope, column in scopes.items()}
    sets = [[F.col(key) for key in keys if key in ("product_id", column)] for column in scopes.values()]
    rows = lines.groupingSets(sets, *keys).agg(F.grouping_id().alias("_set"), *[x.alias(name) for name, x in sums.items()])
    scope = F.coalesce(*[F.when(F.col("_set") == n, s) for s, n in number.items()])
    entity = F.coalesce(*[F.when(F.col("_set") == number[s], F.lit("") if column is None else F.col(column)) for s, column in scopes.items()])
    named = [F.col("_set") == number[s] if column is None else (F.col("_set") == number[s]) & present(F.col(column)) for s, column in scopes.items()]
    return rows.filter(reduce(or_, named)).select(scope.alias("scope"), "product_id", entity.alias("entity"), *sums)


def cutoffs(lines: DataFrame, profiles: DataFrame, cfg: ConsumptionConfig, adjustments: DataFrame | None = None) -> DataFrame:
    """One row per (scope, key) with its metric, scale and threshold.

    The metric is the rate when more than 60 % of the group's lines have one. The scale has a floor so that discrete
    quantities with no spread do not fire on every line.
    """
    groups = (
        _scope_groups(lines, {s: SCOPES[s] for s in Z_METHODS}, {
            "by_rate": F.count("rate") / F.count("*") > 0.6, "integers": F.count_if(F.col("qty") % 1 == 0) / F.count("qty") > 0.9})
        .withColumn("metric", F.when(F.col("by_rate"), "rate").otherwise("qty"))
    )
    rows = groups.join(profiles.filter(F.col("n") >= cfg.min_samples), ["scope", "product_id", "entity", "metric"])
    if adjustments is not None:
        rows = rows.join(adjustments.select("scope", "key", "metric", "threshold_adj"), ["scope", "key", "metric"], "left")
        shift = F.coalesce("threshold_adj", F.lit(0.0))
    else:
        shift = F.lit(0.0)
    discrete = (F.col("metric") == "qty") & (F.col("median") < 10) & F.col("integers")
    floor = F.when(discrete, 1.0).otherwise(0.05 * F.col("median"))
    return rows.select(
        "scope", "product_id", "entity", "metric", "median", "p95", "n",
        F.greatest(F.lit(1.5), F.lit(cfg.z_threshold) + shift).alias("threshold"),
        F.greatest(1.4826 * F.col("mad"), 0.5 * F.col("sd"), floor, F.lit(1e-9)).alias("scale"),
        F.greatest(floor, 0.25 * F.col("median")).alias("min_excess"),
    )


def product_bounds(cuts: DataFrame) -> DataFrame:
    """Per product the lowest value that could exceed any of its cut-offs: a line below it cannot be a z hit."""
    lowest = F.greatest("p95", F.col("median") + F.col("threshold") * F.col("scale"), F.col("median") + F.col("min_excess"))
    bound = {m: F.min(F.when(F.col("metric") == m, lowest)) * (1 - 1e-9) for m in ("qty", "rate")}
    return cuts.groupBy("product_id").agg(bound["qty"].alias("qty_bound"), bound["rate"].alias("rate_bound"))
