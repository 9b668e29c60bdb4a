"""Hypothetical scenarios over the plan, deterministic anticipation and evaluation of past forecasts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.functions.text import contains_text
from stockwarden.operators.balance import criticality, project
from stockwarden.operators.series import KEYS


@dataclass
class Scenario:
    """Demand factors and delivery delays by text fragment; days are steps of the horizon (1 = tomorrow)."""

    name: str
    demand_factors: dict[str, float] = field(default_factory=dict)
    delays: dict[str, int] = field(default_factory=dict)
    delay_all: int = 0
    drop_in_transit: bool = False
    extra_lead_time: float = 0.0
    first_day: int = 1
    last_day: int | None = None


def proposal_flows(active_rows: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Movements the active proposals would add: out of origins and into destinations after the internal lead time."""
    arrival = max(1, round(cfg.internal_lead_time))
    c = F.col
    into = F.when((c("kind") == "transfer") & c("destination").isNotNull(), F.struct(c("destination").alias("location"), c("qty").alias("qty")))
    out = F.when(c("kind").isin("transfer", "quarantine") & c("origin").isNotNull(), F.struct(c("origin").alias("location"), (-c("qty")).alias("qty")))
    rows = active_rows.select("product_id", F.explode(F.array_compact(F.array(into, out))).alias("m"))
    return rows.select("product_id", "m.location", F.lit(arrival).alias("t"), "m.qty")


def _product_of(factors: dict[str, float], *columns: Column) -> Column:
    out = F.lit(1.0)
    for text, factor in factors.items():
        out = out * F.when(contains_text(text, *columns), float(factor)).otherwise(1.0)
    return out


def _compare(rows: DataFrame, demand: DataFrame, base_events: DataFrame, events: DataFrame, extra_lead: float, cfg: SupplyConfig) -> DataFrame:
    """Both projections with the same safety stock and window; rows that get worse, worst first."""
    c = F.col
    lead = c("lead_time") + float(extra_lead)
    window = F.when(c("is_dc"), cfg.horizon).otherwise(F.least(F.lit(cfg.horizon), F.floor(cfg.review_days + lead))).cast("int")
    openings = rows.select(*KEYS, F.coalesce("stock", F.lit(0.0)).alias("opening"), c("safety_stock").alias("safety"), window.alias("window"))
    sides = {}
    for side, qty, moves in (("base", "qty", base_events), ("new", "new_qty", events)):
        flows = moves.join(openings.select(*KEYS), KEYS, "left_semi")
        result = project(openings, demand.select(*KEYS, "step", c(qty).alias("qty")), flows, KEYS, cfg.horizon)
        daily = demand.groupBy(*KEYS).agg(F.avg(qty).alias("daily"))
        joined = rows.select(*KEYS, "stock", "lead_time").join(result, KEYS).join(daily, KEYS)
        state = criticality(c("stockout_day"), c("below_safety_day"), c("window_shortfall"), c("daily"), c("lead_time") + float(extra_lead), cfg.review_days,
                            F.coalesce("stock", F.lit(0.0)), cfg.excess_coverage_days)
        sides[side] = joined.select(*KEYS, state.alias(f"{side}_state"), c("stockout_day").alias(f"{side}_stockout"), c("coverage").alias(f"{side}_coverage"),
                                    c("shortfall").alias(f"{side}_shortfall"))
    rank = lambda s: F.when(s == "out_of_stock", 0).when(s == "critical", 1).when(s == "reorder", 2).otherwise(3)
    both = sides["base"].join(sides["new"], KEYS)
    sooner = c("new_stockout").isNotNull() & (c("base_stockout").isNull() | (c("new_stockout") < c("base_stockout")))
    worse = both.filter((rank(c("new_state")) < rank(c("base_state"))) | sooner)
    return worse.join(rows.select(*KEYS, "product", "hospital", "unit"), KEYS).select(
        *KEYS, "product", "hospital", "unit", "base_state", "new_state", "base_stockout", "new_stockout", "new_coverage",
        F.greatest(F.lit(0.0), c("new_shortfall") - c("base_shortfall")).alias("residual_shortfall"), c("new_shortfall").alias("shortfall"))


def simulate(local: DataFrame, forecast_rows: DataFrame, events: DataFrame, scenario: Scenario, cfg: SupplyConfig, proposals: DataFrame | None = None) -> DataFrame:
    """Locations that get worse under the scenario, against the same plan with the same active proposals."""
    c = F.col
    rows = local.filter((c("level") == "local") & (c("daily_demand") > 0))
    factor = _product_of(scenario.demand_factors, c("hospital"), c("product"), c("location"))
    demand = forecast_rows.select(*KEYS, "step", c("projected").alias("qty")).join(rows.select(*KEYS, factor.alias("factor")), KEYS)
    last = scenario.last_day or cfg.horizon
    demand = demand.withColumn("new_qty", c("qty") * F.when(c("step").between(scenario.first_day, last), c("factor")).otherwise(1.0))
    named = events.join(rows.select(*KEYS, "product"), KEYS)
    late = F.lit(scenario.delay_all)
    for text, days in scenario.delays.items():
        late = late + F.when(contains_text(text, c("ref"), c("supplier"), c("product")), days).otherwise(0)
    inbound = c("qty") > 0
    moved = named.filter(~inbound) if scenario.drop_in_transit else named
    moved = moved.select(*KEYS, F.when(inbound, c("t") + late).otherwise(c("t")).cast("int").alias("t"), "qty")
    base = named.select(*KEYS, "t", "qty")
    if proposals is not None:
        base, moved = base.unionByName(proposals), moved.unionByName(proposals)
    return _compare(rows, demand, base, moved, scenario.extra_lead_time, cfg)


def schedule_growth(local: DataFrame, forecast_rows: DataFrame, events: DataFrame, load: DataFrame, schedule: DataFrame, cfg: SupplyConfig, min_ratio: float = 1.3, growth: float = 1.2,
                    proposals: DataFrame | None = None) -> DataFrame:
    """Every hospital with an unusual schedule at once: its locations' demand grows on the days its schedule spans."""
    c = F.col
    rows = local.filter((c("level") == "local") & (c("daily_demand") > 0))
    step = F.datediff("day", F.lit(cfg.as_of))
    spans = schedule.filter((step >= 1) & (step <= cfg.horizon)).groupBy("hospital").agg(F.min(step).alias("first"), F.max(step).alias("last"))
    busy = load.filter(c("ratio") >= min_ratio).select("hospital").join(spans, "hospital")
    touched = rows.join(busy, "hospital", "left").select(*KEYS, "first", "last")
    demand = forecast_rows.select(*KEYS, "step", c("projected").alias("qty")).join(touched, KEYS)
    demand = demand.withColumn("new_qty", c("qty") * F.when(c("step").between(c("first"), c("last")), growth).otherwise(1.0))
    flows = events.select(*KEYS, "t", "qty")
    flows = flows.unionByName(proposals) if proposals is not None else flows
    return _compare(rows, demand, flows, flows, 0.0, cfg)


def preventive_transfers(plan: DataFrame, free: DataFrame) -> DataFrame:
    """Purchases that arrive after the network's stockout: needs in order of urgency are served from what others can spare.

    Needs and sources of a product are laid end to end, as running sums; where a need's stretch meets a source's stretch, the
    common length moves. So no source gives more than it has, and what one place gets no other is promised.
    """
    c = F.col
    late = plan.filter("level = 'network' and suggested > 0 and in_time = false").select("product_id", c("stockout_date").alias("network_stockout"), c("arrival_date").alias("purchase_arrival"))
    urgent = Window.partitionBy("product_id").orderBy(c("stockout_day").asc_nulls_last(), "location").rowsBetween(Window.unboundedPreceding, 0)
    needs = plan.filter((c("level") == "local") & c("criticality").isin("out_of_stock", "critical") & (c("suggested") > 0)).join(late, "product_id")
    needs = needs.withColumn("n_end", F.sum("suggested").over(urgent)).withColumn("n_start", c("n_end") - c("suggested"))
    fullest = Window.partitionBy("product_id").orderBy(F.desc(F.round("free", 6)), F.desc("location")).rowsBetween(Window.unboundedPreceding, 0)
    sources = free.filter(c("criticality").isin("excess", "ok", "source", "no_movement") & (c("free") > 0)).select("product_id", c("location").alias("origin"), "free")
    sources = sources.withColumn("location", c("origin")).withColumn("s_end", F.sum("free").over(fullest)).withColumn("s_start", c("s_end") - c("free")).drop("location", "free")
    moved = needs.join(sources, "product_id").withColumn("qty", F.least("n_end", "s_end") - F.greatest("n_start", "s_start")).filter(c("qty") > 1e-9)
    return moved.select("product_id", "product", "origin", c("location").alias("destination"), "qty", "network_stockout", "purchase_arrival", c("need_date").alias("needed_on"))


def low_confidence(plan: DataFrame, limit: int | None = None) -> DataFrame:
    from stockwarden.operators.replenish import ordered_plan

    c = F.col
    rows = plan.filter((c("level") == "local") & (c("confidence") == "low") & c("criticality").isin("critical", "reorder", "out_of_stock"))
    return ordered_plan(rows) if limit is None else ordered_plan(rows).limit(limit)


def forecast_errors(forecast_rows: DataFrame, lines: DataFrame, as_of) -> DataFrame:
    """Stored forecasts of days gone by against what was used; a key without consumption counts as zero."""
    c = F.col
    past = forecast_rows.filter(c("day") < F.lit(as_of))
    span = past.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    used = lines.withColumns({"a": span.select("a").scalar(), "b": span.select("b").scalar()}).filter(c("ts").cast("date").between(c("a"), c("b")))
    actual = used.groupBy(*KEYS).agg(F.sum("qty").alias("actual"))
    planned = past.groupBy(*KEYS).agg(F.sum("forecast").alias("forecast"), F.min("product").alias("product"))
    rows = planned.join(actual, KEYS, "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    error = c("forecast") - c("actual")
    return rows.withColumns({"error": error, "wape": F.when(c("actual") != 0, 100 * F.abs(error) / c("actual"))})


def accuracy(errors: DataFrame, *by: str) -> DataFrame:
    """WAPE and bias in % over keys with consumption, by product or overall."""
    known = errors.filter(F.col("wape").isNotNull())
    base = F.greatest(F.sum("actual"), F.lit(1e-9))
    return known.groupBy(*by).agg((100 * F.sum(F.abs("error")) / base).alias("wape"), (100 * F.sum("error") / base).alias("bias"), F.count("*").alias("keys"))
