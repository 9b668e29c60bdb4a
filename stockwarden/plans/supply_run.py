"""One supply run: consumption, stock, pending supply and schedule in; forecasts, plan, classes, expiries and transfers out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.operators import balance, classes, history, methods, rebalance, replenish
from stockwarden.operators.series import KEYS, calendar, capture_gaps, choose_dimension, daily_series, describe_series, located
from stockwarden.session import materialize


def build_series(lines: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Described series per key. The trials are heavy per row, so keys are spread over every core, however few bytes they are."""
    gaps = capture_gaps(lines, cfg.gap_threshold) if cfg.gap_threshold > 0 else None
    described = describe_series(daily_series(lines, cfg, gaps), cfg)
    tasks = 2 * lines.sparkSession.sparkContext.defaultParallelism
    return materialize(methods.rank_keys(described, cfg).repartition(tasks, *KEYS), "series")


def forecast_keys(series: DataFrame, cfg: SupplyConfig) -> DataFrame:
    chosen = materialize(methods.choose_method(methods.trials(series, cfg)), "methods")
    return materialize(methods.forecasts(series, chosen, cfg), "forecast-keys")


def stock_at(stock: DataFrame, dimension: str) -> DataFrame:
    """Stock keyed by the plan's location: the full location for sublocations, else the warehouse."""
    place = "location" if dimension == "sublocation" else "warehouse"
    return stock.withColumn("location", F.trim(place))


def run_supply(consumption: DataFrame, stock: DataFrame, pending: DataFrame, schedule: DataFrame, cfg: SupplyConfig,
               lead_times: DataFrame | None = None, purchase_units: DataFrame | None = None, multiples: DataFrame | None = None,
               committed_out: DataFrame | None = None, committed_in: DataFrame | None = None) -> dict[str, DataFrame]:
    dimension = choose_dimension(consumption, cfg.dimension)
    lines = located(consumption, dimension)
    _, end = calendar(lines, cfg)
    end_ts = F.lit(end).cast("timestamp_ntz")
    chosen = forecast_keys(build_series(lines, cfg), cfg).withColumn("series_end", F.lit(end))
    places = balance.main_hospitals(lines)
    scheduled = balance.agenda(schedule, balance.case_usage(lines, end_ts), places, cfg)
    forecast_rows = materialize(balance.with_agenda(methods.daily_forecasts(chosen, cfg), scheduled), "forecasts")
    events = materialize(balance.supply_events(pending, cfg), "events")
    costs = materialize(replenish.unit_costs(lines), "costs")
    on_hand = stock_at(stock, dimension)
    names = lines.groupBy("product_id").agg(F.min("product").alias("product"), F.min("unit").alias("unit"))
    catalogue = on_hand.select("product_id").union(names.select("product_id")).distinct()
    terms = materialize(replenish.product_terms(catalogue, lead_times, purchase_units, multiples), "terms")
    parameters = materialize(replenish.local_parameters(chosen, terms, on_hand, cfg), "parameters")
    used = replenish.local_rows(parameters, forecast_rows, events, places, costs, cfg)
    idle = replenish.stock_only_rows(used, on_hand, events, terms, names, places, costs, cfg)
    local = materialize(used.unionByName(idle, allowMissingColumns=True), "local")
    network = replenish.network_rows(local, forecast_rows, events, on_hand, terms, costs, cfg)
    plan = materialize(local.unionByName(network, allowMissingColumns=True), "plan")
    transfers = materialize(rebalance.propose_transfers(local, cfg, committed_out, committed_in), "transfers")
    openings = parameters.select(*KEYS, F.coalesce("stock", F.lit(0.0)).alias("opening"), "safety", "window")
    return {
        "plan": plan,
        "forecasts": forecast_rows,
        "network_forecasts": replenish.network_forecast(forecast_rows),
        "abc_xyz": classes.abc_xyz(lines, end_ts),
        "expiries": classes.expiry_risk(on_hand, local, cfg),
        "transfers": rebalance.coverage_after(transfers, openings, forecast_rows.select(*KEYS, "step", F.col("projected").alias("qty")),
                                              events.select(*KEYS, "t", "qty"), cfg),
        "late": pending.filter("late"),
        "summary": replenish.plan_summary(plan),
        "growth": history.growth(lines, end_ts),
        "events": events,
        "openings": openings,
        **history.demand_history(lines),
    }
