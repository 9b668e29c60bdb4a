"""Replenishment rows: local keys, stock without consumption, and the network level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.config import CRITICALITY_RANK, NETWORK, SupplyConfig
from stockwarden.functions.maths import reorder_point, round_unit, safety_stock, to_multiple
from stockwarden.functions.text import unit_decimals
from stockwarden.operators.balance import criticality, project
from stockwarden.operators.series import KEYS


def is_dc(location: Column, cfg: SupplyConfig) -> Column:
    named = F.lower(location).contains(cfg.dc_name)
    return named | location.isin(*cfg.dc_locations) if cfg.dc_locations else named


def product_terms(products: DataFrame, lead_times: DataFrame | None, purchase_units: DataFrame | None, multiples: DataFrame | None) -> DataFrame:
    """Per product: supplier lead time, purchase unit and ratio, order multiple; absent ones stay NULL."""
    rows = products
    for table, columns in ((lead_times, {"days": "supplier_days"}), (purchase_units, {"purchase_unit": "purchase_unit", "ratio": "ratio"}),
                           (multiples, {"multiple": "own_multiple"})):
        kinds = {"supplier_days": "double", "purchase_unit": "string", "ratio": "double", "own_multiple": "double"}
        if table is None:
            rows = rows.withColumns({new: F.lit(None).cast(kinds[new]) for new in columns.values()})
        else:
            rows = rows.join(table.select("product_id", *[F.col(old).alias(new) for old, new in columns.items()]), "product_id", "left")
    return rows


def _suggest(shortfall: Column, multiple: Column, unit: Column) -> Column:
    packs = to_multiple(shortfall, multiple)
    return F.when(packs > 0, round_unit(packs, unit_decimals(unit), "up")).otherwise(0.0)


def confidence(wape: Column, insufficient: Column) -> Column:
    return F.when(insufficient | (wape > 0.5), "low").when(wape > 0.25, "medium").otherwise("high")


def _dates(cfg: SupplyConfig) -> dict[str, Column]:
    return {
        "stockout_date": F.date_add(F.lit(cfg.as_of), F.col("stockout_day")),
        "need_date": F.date_add(F.lit(cfg.as_of), F.col("need_day")),
    }


def local_parameters(chosen: DataFrame, terms: DataFrame, stock: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Lead time, safety stock, reorder point and opening stock per key."""
    c = F.col
    on_hand = stock.groupBy(*KEYS).agg(F.sum("qty").alias("stock_total"), F.sum("usable").alias("stock_usable"), F.sum("reserved").alias("reserved"))
    rows = chosen.join(terms, "product_id", "left").join(on_hand, KEYS, "left").withColumn("is_dc", is_dc(c("location"), cfg))
    lead = F.when(c("is_dc"), F.coalesce("supplier_days", F.lit(cfg.lead_time))).otherwise(cfg.internal_lead_time)
    rows = rows.withColumns({
        "lead_time": lead, "lead_sigma": F.when(c("is_dc"), cfg.lead_time_cv * lead).otherwise(0.0),
        "stock": c("stock_usable") if cfg.use_usable else c("stock_total")})
    rows = rows.withColumn("safety", safety_stock(cfg.z, c("lead_time"), c("sigma"), c("daily"), c("lead_sigma")))
    return rows.withColumns({
        "reorder_point": reorder_point(c("daily"), c("lead_time"), c("safety")),
        "window": F.when(c("is_dc"), cfg.horizon).otherwise(F.least(F.lit(cfg.horizon), F.floor(cfg.review_days + c("lead_time")))).cast("int")})


def local_rows(parameters: DataFrame, forecast_rows: DataFrame, events: DataFrame, places: DataFrame, costs: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """One replenishment row per key with consumption. Base and review-window balances come from the same projection."""
    c = F.col
    openings = parameters.select(*KEYS, F.coalesce("stock", F.lit(0.0)).alias("opening"), "safety", "window")
    demand = forecast_rows.select(*KEYS, "step", c("projected").alias("qty"))
    mine = events.select(*KEYS, "t", "qty")
    balance = project(openings, demand, mine, KEYS, cfg.horizon)
    planned = forecast_rows.groupBy(*KEYS).agg(
        F.sum("projected").alias("horizon_demand"), F.sum("agenda").alias("committed"),
        F.sum(F.greatest(F.lit(0.0), c("agenda") - c("forecast"))).alias("agenda_excess"), F.count_if(c("agenda") > 0).alias("agenda_days"))
    moving = events.groupBy(*KEYS).agg(
        F.sum(F.when(c("qty") > 0, c("qty")).otherwise(0.0)).alias("inbound"), F.sum(F.when(c("qty") < 0, -c("qty")).otherwise(0.0)).alias("outbound"),
        F.min(F.when(c("qty") > 0, c("t"))).alias("first_arrival"))
    rows = (
        parameters.join(balance, KEYS).join(planned, KEYS, "left").join(moving, KEYS, "left")
        .join(places, "location", "left").join(costs, "product_id", "left")
    )
    packs = F.when(c("is_dc") & (c("ratio") > 1), c("ratio"))
    multiple = F.coalesce(F.nullif("own_multiple", F.lit(0.0)), packs, F.lit(cfg.default_multiple or 1.0))
    rows = rows.withColumns({
        "suggested": _suggest(c("window_shortfall"), multiple, c("unit")), "days_idle": F.datediff(c("series_end"), c("last_used")),
        "inbound": F.coalesce("inbound", F.lit(0.0)), "outbound": F.coalesce("outbound", F.lit(0.0))})
    rule = criticality(c("stockout_day"), c("below_safety_day"), c("suggested"), c("daily"), c("lead_time"), cfg.review_days, c("stock"), cfg.excess_coverage_days)
    state = (
        F.when(c("stock").isNull(), "no_stock_record")
        .when((c("daily") > 0) & (c("days_idle") > cfg.idle_days) & (c("stock") > 0), "no_movement").otherwise(rule))
    return rows.select(
        *KEYS, "product", "hospital", "unit", F.lit("local").alias("level"), "stock", "stock_total", "reserved", "inbound", "outbound",
        (c("closing") + c("horizon_demand")).alias("projected_stock"), "lowest", "closing", "stockout_day", "need_day", "first_arrival",
        c("daily").alias("daily_demand"), "sigma", "lead_time", c("safety").alias("safety_stock"), "reorder_point", "horizon_demand", "committed",
        "agenda_excess", "agenda_days", "suggested", F.when((c("ratio") > 1) & (c("suggested") > 0), F.ceil(c("suggested") / c("ratio")).cast("double")).alias("suggested_packs"),
        "purchase_unit", "ratio", F.when(c("daily") > 0, c("coverage")).alias("coverage"), state.alias("criticality"), "method", "wape", "bias",
        confidence(c("wape"), c("insufficient")).alias("confidence"), "intermittent", "zero_share", "is_dc", F.coalesce("unit_cost", F.lit(0.0)).alias("unit_cost"),
        (c("suggested") * F.coalesce("unit_cost", F.lit(0.0))).alias("suggested_amount"), (c("stock") * F.coalesce("unit_cost", F.lit(0.0))).alias("stock_value"),
        "days_idle", "imputed", c("n").alias("history_days"), "last_28d", "prev_28d",
    ).withColumns(_dates(cfg))


def stock_only_rows(local: DataFrame, stock: DataFrame, events: DataFrame, terms: DataFrame, names: DataFrame, places: DataFrame, costs: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Usable stock where nothing is consumed: a source at a distribution centre, idle elsewhere."""
    c = F.col
    on_hand = stock.groupBy(*KEYS).agg(F.sum("qty").alias("stock_total"), F.sum("usable").alias("stock_usable"), F.sum("reserved").alias("reserved"))
    level = c("stock_usable") if cfg.use_usable else c("stock_total")
    rows = on_hand.withColumn("stock", level).filter("stock > 0").join(local.select(*KEYS), KEYS, "left_anti")
    moving = events.groupBy(*KEYS).agg(
        F.sum(F.when(c("qty") > 0, c("qty")).otherwise(0.0)).alias("inbound"), F.sum(F.when(c("qty") < 0, -c("qty")).otherwise(0.0)).alias("outbound"))
    rows = (
        rows.join(moving, KEYS, "left").join(terms, "product_id", "left").join(names, "product_id", "left").join(places, "location", "left")
        .join(costs, "product_id", "left").withColumn("is_dc", is_dc(c("location"), cfg))
    )
    inbound, outbound = F.coalesce("inbound", F.lit(0.0)), F.coalesce("outbound", F.lit(0.0))
    end = c("stock") + inbound - outbound
    zero, cost = F.lit(0.0), F.coalesce("unit_cost", F.lit(0.0))
    return rows.select(
        *KEYS, F.coalesce("product", c("product_id").cast("string")).alias("product"), F.coalesce("hospital", F.lit("")).alias("hospital"),
        F.coalesce("unit", F.lit("")).alias("unit"), F.lit("local").alias("level"), "stock", "stock_total", "reserved", inbound.alias("inbound"),
        outbound.alias("outbound"), end.alias("projected_stock"), end.alias("lowest"), end.alias("closing"), zero.alias("daily_demand"), zero.alias("sigma"),
        F.when(c("is_dc"), F.coalesce("supplier_days", F.lit(cfg.lead_time))).otherwise(cfg.internal_lead_time).alias("lead_time"),
        zero.alias("safety_stock"), zero.alias("reorder_point"), zero.alias("horizon_demand"), zero.alias("committed"), zero.alias("agenda_excess"),
        F.lit(0).cast("bigint").alias("agenda_days"), zero.alias("suggested"), "purchase_unit", "ratio",
        F.when(c("is_dc"), "source").otherwise("no_movement").alias("criticality"), F.lit("no local consumption").alias("method"), F.lit("n/a").alias("confidence"),
        F.lit(False).alias("intermittent"), F.lit(1.0).alias("zero_share"), "is_dc", cost.alias("unit_cost"), zero.alias("suggested_amount"),
        (c("stock") * cost).alias("stock_value"), F.lit(9999).alias("days_idle"), F.lit(0).alias("imputed"), F.lit(0).alias("history_days"), zero.alias("last_28d"))


def network_forecast(forecast_rows: DataFrame) -> DataFrame:
    return forecast_rows.groupBy("product_id", "step", "day").agg(
        *[F.sum(x).alias(x) for x in ("forecast", "lower", "upper", "projected", "agenda")])


def daily_by_product(forecast_rows: DataFrame) -> DataFrame:
    """Planned demand of every product by day; a report turns products into columns where it shows few of them."""
    return forecast_rows.groupBy("product_id", "step", "day").agg(F.sum("projected").alias("projected"))


def network_rows(local: DataFrame, forecast_rows: DataFrame, events: DataFrame, stock: DataFrame, terms: DataFrame, costs: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """One row per product: the network's demand against all usable stock and purchases under way."""
    c = F.col
    used = c("method") != "no local consumption"
    weight = F.when(used & c("wape").isNotNull(), c("last_28d") + 1e-9)
    sums = local.groupBy("product_id").agg(
        F.min("product").alias("product"), F.min("unit").alias("unit"), F.coalesce(F.sum(F.when(used, c("daily_demand"))), F.lit(0.0)).alias("daily"),
        F.sqrt(F.coalesce(F.sum(F.when(used, c("sigma") * c("sigma"))), F.lit(0.0))).alias("sigma"),
        *[F.coalesce(F.sum(F.when(used, c(x))), F.lit(0.0)).alias(x) for x in ("horizon_demand", "committed", "agenda_excess")],
        F.coalesce(F.max(F.when(used, c("agenda_days"))), F.lit(0)).alias("agenda_days"), (F.sum(c("wape") * weight) / F.sum(weight)).alias("wape"),
        F.min("days_idle").alias("days_idle"), F.coalesce(F.sum(F.when(used, c("imputed"))), F.lit(0)).alias("imputed"),
        F.coalesce(F.max(F.when(used, c("history_days"))), F.lit(0)).alias("history_days"), F.sum("last_28d").alias("last_28d"), F.sum("prev_28d").alias("prev_28d"))
    on_hand = stock.groupBy("product_id").agg(F.sum("qty").alias("stock_total"), F.sum("usable").alias("stock_usable"), F.sum("reserved").alias("reserved"))
    bought = events.filter("kind = 'purchase' and qty > 0")
    arriving = bought.groupBy("product_id").agg(F.sum("qty").alias("inbound"), F.min("t").alias("first_arrival"))
    rows = sums.join(on_hand, "product_id", "left").join(terms, "product_id", "left").join(arriving, "product_id", "left").join(costs, "product_id", "left")
    lead = F.coalesce("supplier_days", F.lit(cfg.lead_time))
    rows = rows.withColumns({
        "stock": F.coalesce("stock_usable" if cfg.use_usable else "stock_total", F.lit(0.0)), "lead_time": lead, "inbound": F.coalesce("inbound", F.lit(0.0)),
        "unit_cost": F.coalesce("unit_cost", F.lit(0.0)), "stock_total": F.coalesce("stock_total", F.lit(0.0)), "reserved": F.coalesce("reserved", F.lit(0.0))})
    rows = rows.withColumn("safety", safety_stock(cfg.z, c("lead_time"), c("sigma"), c("daily"), cfg.lead_time_cv * c("lead_time")))
    openings = rows.select("product_id", c("stock").alias("opening"), "safety", F.lit(cfg.horizon).alias("window"))
    demand = network_forecast(forecast_rows).select("product_id", "step", c("projected").alias("qty"))
    rows = rows.join(project(openings, demand, bought.select("product_id", "t", "qty"), ["product_id"], cfg.horizon), "product_id")
    multiple = F.coalesce(F.nullif("own_multiple", F.lit(0.0)), F.when(c("ratio") > 1, c("ratio")), F.lit(cfg.default_multiple or 1.0))
    rows = rows.withColumn("suggested", _suggest(c("shortfall"), multiple, c("unit")))
    q, arrives = c("stockout_day"), F.ceil("lead_time")
    state = (
        F.when(c("daily") <= 0, "ok").when(q <= 1, "out_of_stock").when(q <= c("lead_time"), "critical")
        .when(c("below_safety_day") <= c("lead_time") + cfg.review_days, "reorder")
        .when(q.isNull() & (c("stock") / c("daily") > cfg.excess_coverage_days), "excess").otherwise("ok"))
    return rows.select(
        "product_id", F.lit(NETWORK).alias("location"), "product", F.lit("").alias("hospital"), "unit", F.lit("network").alias("level"), "stock", "stock_total", "reserved",
        "inbound", F.lit(0.0).alias("outbound"), (c("stock") + c("inbound")).alias("projected_stock"), "lowest", "closing", "stockout_day", "need_day", "first_arrival",
        c("daily").alias("daily_demand"), "sigma", "lead_time", c("safety").alias("safety_stock"), reorder_point(c("daily"), c("lead_time"), c("safety")).alias("reorder_point"),
        "horizon_demand", "committed", "agenda_excess", "agenda_days", "suggested",
        F.when((c("ratio") > 1) & (c("suggested") > 0), F.ceil(c("suggested") / c("ratio") - 1e-9).cast("double")).alias("suggested_packs"), "purchase_unit", "ratio",
        (c("purchase_unit").isNotNull() & c("ratio").isNull()).alias("conversion_missing"), F.when(q.isNotNull(), arrives <= q).alias("in_time"),
        F.when(q.isNotNull(), (q - arrives).cast("int")).alias("slack_days"), F.date_add(F.lit(cfg.as_of), arrives.cast("int")).alias("arrival_date"),
        F.when(c("daily") > 0, c("coverage")).alias("coverage"), state.alias("criticality"), F.lit("sum of locations").alias("method"), "wape",
        confidence(F.coalesce("wape", F.lit(0.0)), F.lit(False)).alias("confidence"), F.lit(False).alias("intermittent"), F.lit(0.0).alias("zero_share"), F.lit(True).alias("is_dc"),
        "unit_cost", (c("suggested") * c("unit_cost")).alias("suggested_amount"), (c("stock") * c("unit_cost")).alias("stock_value"), "days_idle", "imputed", "history_days",
        "last_28d", "prev_28d",
    ).withColumns(_dates(cfg))


def unit_costs(lines: DataFrame) -> DataFrame:
    """Amount over quantity per product."""
    return lines.groupBy("product_id").agg(F.try_divide(F.sum("amount"), F.sum("qty")).alias("unit_cost")).fillna(0.0)


def ordered_plan(plan: DataFrame) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("criticality") == k, v) for k, v in CRITICALITY_RANK.items()])
    return plan.orderBy(rank, F.col("coverage").asc_nulls_last(), "product_id", "location")


def plan_view(plan: DataFrame, level: str = "local", state: str = "", product: str = "", location: str = "", limit: int = 25) -> DataFrame:
    """Filtered look at the plan in its own order."""
    from stockwarden.functions.text import contains_text

    rows = plan.filter(F.col("level") == level)
    if state:
        rows = rows.filter(F.col("criticality") == state)
    if product:
        rows = rows.filter(contains_text(product, F.col("product")))
    if location:
        rows = rows.filter(contains_text(location, F.col("location")))
    return ordered_plan(rows).limit(limit)


def plan_summary(plan: DataFrame) -> DataFrame:
    """Counts and money of a run in one pass over the plan."""
    c = F.col
    local, net = c("level") == "local", c("level") == "network"
    known = local & c("wape").isNotNull()
    idle = c("criticality").isin("excess", "no_movement")
    weight = c("last_28d") + 1e-9
    zero = F.lit(0.0)
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, c(x))), zero)
    return plan.agg(
        F.count("*").alias("rows"), *[F.count_if(local & (c("criticality") == k)).alias(k) for k in CRITICALITY_RANK],
        *[F.count_if(local & (c("confidence") == k)).alias(f"confidence_{k}") for k in ("high", "medium", "low")],
        F.count_if(local & (c("method") == "insufficient")).alias("insufficient"), total(net, "suggested_amount").alias("purchase_amount"),
        total(local, "suggested_amount").alias("internal_amount"), total(net, "stock_value").alias("stock_value"), total(local & idle, "stock_value").alias("idle_value"),
        F.count_if(net & (c("suggested") > 0)).alias("products_to_buy"), (100 * F.avg(F.when(known, c("wape")))).alias("wape_mean"),
        (100 * F.sum(F.when(known, c("wape") * weight)) / F.sum(F.when(known, weight))).alias("wape_weighted"),
        (100 * F.avg(F.when(local, c("bias")))).alias("bias_mean"), F.coalesce(F.sum(F.when(local, c("imputed"))), F.lit(0)).alias("imputed_days"),
        total(local, "inbound").alias("inbound"), total(local, "committed").alias("committed"))


def compare_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Alerts that are new and alerts that are resolved between two runs of local rows."""
    c = F.col
    alarm = ("out_of_stock", "critical", "reorder")
    before = previous.filter(c("level") == "local").filter(c("criticality").isin(*alarm)).select(*KEYS, c("criticality").alias("was"))
    now = current.filter(c("level") == "local").select(*KEYS, c("criticality").alias("now"))
    both = before.join(now, KEYS, "full_outer")
    change = F.when(c("was").isNull() & c("now").isin(*alarm), "new").when(
        c("was").isNotNull() & F.coalesce(c("now").isin("ok", "excess"), F.lit(True)), "resolved")
    return both.withColumn("change", change).filter(c("change").isNotNull())
