"""Products, places, partners, units of measure, purchase units and supplier lead times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.functions.maths import decimals_from_step
from stockwarden.functions.text import contains_text
from stockwarden.session import materialize


def products(table: DataFrame, storable_only: bool = True, limit: int = 0) -> DataFrame:
    rows = table.filter("active")
    if storable_only:
        rows = rows.filter(F.col("kind").isin("product", "consu"))
    return rows.limit(limit) if limit else rows


def locations(table: DataFrame, internal_only: bool = True) -> DataFrame:
    return table.filter(F.col("usage") == "internal") if internal_only else table


def medical_units(partners: DataFrame, flag: str | None) -> DataFrame:
    """Partners flagged as hospitals; no rows when the installation has no such flag."""
    if not flag or flag not in partners.columns:
        return partners.filter(F.lit(False))
    return partners.filter(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def find_by_name(table: DataFrame, text: str, *columns: str, limit: int | None = None) -> DataFrame:
    """Name lookup: literal text in any of the columns, by id; the first `limit` rows if the caller sets it."""
    found = table.filter(contains_text(text, *[F.col(c) for c in columns]))
    return found.orderBy("id") if limit is None else found.orderBy("id").limit(limit)


def _walked(steps: DataFrame, rounds: int) -> DataFrame:
    """(unit_id, at_id, divisor, ended): every pointer doubled until all chains have ended or `rounds` are over.

    A step that has ended points to itself with divisor 1, so joining a table of steps with itself doubles their length.
    """
    for _ in range(rounds):
        if not steps.where("not ended").take(1):
            break
        ahead = steps.select(F.col("unit_id").alias("at_id"), F.col("at_id").alias("next_id"), F.col("divisor").alias("more"), F.col("ended").alias("done"))
        steps = steps.join(ahead, "at_id").select("unit_id", F.col("next_id").alias("at_id"), (F.col("divisor") * F.col("more")).alias("divisor"), F.col("done").alias("ended"))
        steps = materialize(steps, "unit-steps")
    return steps


def absolute_factors(units: DataFrame) -> DataFrame:
    """Absolute factor of every unit: its own when stored, else 1 over the product of relative factors up the chain.

    A chain ends at a unit with a stored factor, at one without a (known) parent, or where it would revisit a unit: units of
    a cycle have 1 over the product of its relative factors. Chains may have any depth; log2 of it joins resolve them.
    """
    clean = units.select(
        "unit_id", "name", "rounding", "factor", F.when(F.col("parent_id") != F.col("unit_id"), F.col("parent_id")).alias("parent_id"),
        F.coalesce(F.nullif("relative_factor", F.lit(0.0)), F.lit(1.0)).alias("relative"))
    parents = clean.select(F.col("unit_id").alias("parent_id"), F.lit(True).alias("known"))
    clean = materialize(clean.join(parents, "parent_id", "left").withColumn("parent_id", F.when(F.col("known"), F.col("parent_id"))).drop("known"), "units")
    ended = F.col("factor").isNotNull() | F.col("parent_id").isNull()
    first = clean.select("unit_id", F.when(ended, F.col("unit_id")).otherwise(F.col("parent_id")).alias("at_id"),
                         F.when(ended, 1.0).otherwise(F.col("relative")).alias("divisor"), ended.alias("ended"))
    rounds = clean.count().bit_length() + 1
    # `ended` of a first step speaks of the unit itself; a step's end is known after it was joined once.
    steps = _walked(materialize(first, "unit-steps"), rounds)
    own_root = F.when(F.col("factor").isNotNull(), F.coalesce(F.nullif("factor", F.lit(0.0)), F.lit(1.0))).otherwise(1.0 / F.col("relative"))
    roots = clean.select(F.col("unit_id").alias("at_id"), own_root.alias("root"))
    if steps.where("not ended").take(1):
        # After that many steps every open pointer stands on a cycle, and all units of cycles are stood on.
        on_cycle = materialize(steps.where("not ended").select(F.col("at_id").alias("unit_id")).distinct(), "unit-cycles")
        ring = clean.join(on_cycle, "unit_id").select("unit_id", F.col("parent_id").alias("at_id"), "relative")
        least = ring.select("unit_id", "at_id", F.least("unit_id", "at_id").alias("least"))
        for _ in range(rounds):  # the smallest unit of a cycle names it
            ahead = least.select(F.col("unit_id").alias("at_id"), F.col("at_id").alias("next_id"), F.col("least").alias("other"))
            least = materialize(least.join(ahead, "at_id").select("unit_id", F.col("next_id").alias("at_id"), F.least("least", "other").alias("least")), "unit-cycles")
        named = ring.select("unit_id", "relative").join(least.select("unit_id", "least"), "unit_id")
        whole = named.join(named.groupBy("least").agg(F.product("relative").alias("whole")), "least").select(F.col("unit_id").alias("at_id"), (1.0 / F.col("whole")).alias("root"))
        roots = roots.join(on_cycle.withColumnRenamed("unit_id", "at_id"), "at_id", "left_anti").unionByName(whole)
        cut = first.join(on_cycle.withColumn("ring", F.lit(True)), "unit_id", "left")
        cut = cut.select("unit_id", F.when(F.col("ring"), F.col("unit_id")).otherwise(F.col("at_id")).alias("at_id"), F.when(F.col("ring"), 1.0).otherwise(F.col("divisor")).alias("divisor"),
                         (F.col("ended") | F.coalesce("ring", F.lit(False))).alias("ended"))
        steps = _walked(materialize(cut, "unit-steps"), rounds)
    return clean.join(steps, "unit_id").join(roots, "at_id").select("unit_id", "name", "rounding", (F.col("root") / F.col("divisor")).alias("factor"))


def unit_precision(units: DataFrame) -> DataFrame:
    return units.select(F.col("name").alias("unit"), decimals_from_step(F.coalesce("rounding", F.lit(1.0))).alias("decimals"))


def principal_supplier(suppliers: DataFrame, key: str, *values: str) -> DataFrame:
    """Per key the supplier row with the lowest (sequence, id)."""
    chosen = F.min_by(F.struct(*values), F.struct("sequence", "id"))
    return (
        suppliers.filter(F.col(key).isNotNull()).groupBy(key).agg(chosen.alias("s"))
        .select(key, *[F.col(f"s.{v}").alias(v) for v in values])
    )


def lead_times(suppliers: DataFrame) -> DataFrame:
    """Delay of the principal supplier per product; a template-level row counts for its template id."""
    keyed = suppliers.withColumn("key", F.coalesce("product_id", "template_id")).filter(F.col("delay").isNotNull())
    return principal_supplier(keyed, "key", "delay").select(F.col("key").alias("product_id"),
                                                           F.col("delay").cast("double").alias("days"))


def purchase_units(product_table: DataFrame, suppliers: DataFrame, factors: DataFrame) -> DataFrame:
    """Purchase unit per product (own, else the supplier's by product, else by template) and base units in one.

    `ratio` is NULL when the unit is known and the conversion is not; such a purchase must be blocked.
    """
    with_unit = suppliers.filter(F.col("unit_id").isNotNull())
    by_product = principal_supplier(with_unit, "product_id", "unit_id").withColumnRenamed("unit_id", "unit_by_product")
    by_template = principal_supplier(with_unit, "template_id", "unit_id").withColumnRenamed("unit_id", "unit_by_template")
    own: Column = F.col("purchase_unit_id") if "purchase_unit_id" in product_table.columns else F.lit(None).cast("bigint")
    base = factors.select(F.col("unit_id").alias("base_unit_id"), F.col("name").alias("base_unit"), F.col("factor").alias("base_factor"))
    bought = factors.select(F.col("unit_id").alias("buy_unit_id"), F.col("name").alias("purchase_unit"), F.col("factor").alias("buy_factor"))
    rows = (
        product_table.filter("active").select("product_id", "template_id", "base_unit_id", own.alias("own_unit"))
        .join(by_product, "product_id", "left")
        .join(by_template, "template_id", "left")
        .withColumn("buy_unit_id", F.coalesce("own_unit", "unit_by_product", "unit_by_template"))
        .filter(F.col("buy_unit_id").isNotNull() & (F.col("buy_unit_id") != F.col("base_unit_id")))
        .join(base, "base_unit_id", "left")
        .join(bought, "buy_unit_id", "left")
    )
    return rows.select("product_id", "base_unit", "purchase_unit",
                       (F.nullif("base_factor", F.lit(0.0)) / F.nullif("buy_factor", F.lit(0.0))).alias("ratio"))
