"""Transfers between locations: operating reserves, joint allocation and coverage after a transfer."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.functions.text import region, unit_decimals
from stockwarden.operators.series import KEYS
from stockwarden.session import materialize

#: Needs of one product that are served in one round.
BLOCK = 20_000


def regions_of(places: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Region of each location: exact mapping, else a mapped name inside it, else its own leading letters."""
    exact, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, value in reversed(list(mapping.items())):
        exact = F.when(F.col("location") == name, value).otherwise(exact)
        inside = F.when(F.upper("location").contains(name.upper()), value).otherwise(inside)
    return places.withColumn("region", F.coalesce(exact, inside, region(F.col("location"))))


def operating_reserve(local: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """What a location keeps: 1.5 reorder points plus horizon demand for its own use; a distribution centre also keeps
    its region's daily demand for some days, or an equal share of the network's when no location shares its region."""
    c = F.col
    placed = regions_of(local, cfg.regions)
    served = placed.filter(~c("is_dc") & (c("daily_demand") > 0))
    by_region = served.groupBy("product_id", "region").agg(F.sum("daily_demand").alias("region_demand"))
    by_product = served.groupBy("product_id").agg(F.sum("daily_demand").alias("network_demand"))
    centres = placed.filter("is_dc").groupBy("product_id").agg(F.count("*").alias("centres"))
    rows = placed.join(by_region, ["product_id", "region"], "left").join(by_product, "product_id", "left").join(centres, "product_id", "left")
    own = F.when(c("daily_demand") > 0, c("reorder_point") * 1.5 + c("horizon_demand")).otherwise(0.0)
    around = F.coalesce(F.when(c("region_demand") > 0, c("region_demand")), c("network_demand") / F.greatest(c("centres"), F.lit(1)), F.lit(0.0))
    reserve = own + F.when(c("is_dc"), around * cfg.dc_reserve_days).otherwise(0.0)
    return rows.withColumn("reserve", reserve).drop("region_demand", "network_demand", "centres")


_MOVES = "product_id long, origin string, destination string, qty double, free_before double, reserve double, committed_before double, covered_before double, place long"


def serve_block(needs: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Movements for some needs of one product, in order of rank, from its sources in order of rank.

    Whole units are counted, so nothing is lost to rounding. A need takes from its own region first, then from the others. Both
    lists are only ever consumed from the front, so one pass over needs and sources does it.
    """
    needs, sources = needs.sort_values("rank"), sources.sort_values("rank")
    left, places, homes = sources["left"].tolist(), sources["location"].tolist(), sources["region"].tolist()
    own: dict[str, list[int]] = {}
    for i, home in enumerate(homes):
        if home is not None:
            own.setdefault(home, []).append(i)
    everywhere, front, moves = list(range(len(left))), {}, []
    for n, (missing, place, home) in enumerate(zip(needs["missing"].tolist(), needs["location"].tolist(), needs["region"].tolist(), strict=True)):
        for key, line in ((("own", home), own.get(home, [])), ("all", everywhere)):
            at = front.get(key, 0)
            while at < len(line) and left[line[at]] <= 0:
                at += 1
            front[key] = at
            while missing > 0 and at < len(line):
                i = line[at]
                if left[i] > 0 and places[i] != place:
                    qty = min(missing, left[i])
                    moves.append((n, i, qty, left[i]))
                    left[i] -= qty
                    missing -= qty
                at += 1
    n, i, qty, before = (np.array(x, np.int64) for x in (zip(*moves, strict=True) if moves else ([], [], [], [])))
    need, source = needs.iloc[n].reset_index(drop=True), sources.iloc[i].reset_index(drop=True)
    unit = need["unit_size"]
    return pd.DataFrame({
        "product_id": need["product_id"], "origin": source["location"], "destination": need["location"], "qty": qty / unit, "free_before": before / unit, "reserve": source["reserve"],
        "committed_before": source["committed_out"] + (source["capacity"] - before) / unit, "covered_before": need["committed_in"], "place": source["rank"]})


def allocated(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Free stock given to needs by urgency, product by product; one row per movement.

    Needs are served in rounds of at most `block` a product, all products at once. A round meets its needs with the front of the
    product's sources only, as much of every region as the round could take in all, and what it gave is deducted before the
    next. So no task sees a whole product, and the result is that of serving one need after the other.
    """
    c = F.col
    urgency = F.when(c("criticality") == "out_of_stock", 0).when(c("criticality") == "critical", 1).when(c("criticality") == "reorder", 2)
    rows = rows.withColumn("decimals", unit_decimals(c("unit")))
    by_urgency = Window.partitionBy("product_id").orderBy(c("stockout_day").isNull(), "stockout_day", urgency, F.desc("suggested"), "location")
    size = F.pow(F.lit(10.0), "decimals")
    asked = rows.filter(urgency.isNotNull() & (c("suggested") > 0))
    needs = asked.select(
        c("product_id").cast("long"), F.row_number().over(by_urgency).cast("long").alias("rank"), "location", "region", "committed_in", F.first("decimals").over(by_urgency).alias("decimals"),
        F.ceil(F.greatest(F.lit(0.0), c("suggested") - c("committed_in")) * size - 1e-9).alias("missing"))
    needs = materialize(needs.withColumn("unit_size", F.pow(F.lit(10.0), "decimals")), "needs")
    units = needs.groupBy("product_id").agg(F.first("unit_size").alias("unit_size"), F.max("rank").alias("needs"))
    kind = F.when(c("is_dc"), 0).when(c("criticality") == "excess", 1).otherwise(2)
    stock = F.coalesce("projected_stock", F.lit(0.0))
    by_stock = Window.partitionBy("product_id").orderBy(kind, -stock, "location")
    held = rows.filter(c("criticality").isin("excess", "ok", "no_movement", "source")).join(units, "product_id")
    free = F.floor(F.greatest(F.lit(0.0), stock - c("reserve") - c("committed_out")) * c("unit_size") + 1e-9)
    sources = held.select(c("product_id").cast("long"), F.row_number().over(by_stock).cast("long").alias("rank"), "location", "region", "reserve", "committed_out", free.alias("capacity"))
    sources = materialize(sources.filter("capacity > 0").withColumn("left", c("capacity")), "sources")
    most = units.agg(F.max("needs")).first()[0] or 0
    before = Window.partitionBy("product_id", "region").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rounds = []
    for start in range(0, most, block):
        some = needs.filter((c("rank") > start) & (c("rank") <= start + block) & (c("missing") > 0))
        want = some.groupBy("product_id").agg(F.sum("missing").alias("want"))
        near = sources.filter("left > 0").withColumn("ahead", F.coalesce(F.sum("left").over(before), F.lit(0))).join(want, "product_id").filter("ahead < want").drop("ahead", "want")
        moves = some.groupBy("product_id").cogroup(near.groupBy("product_id")).applyInPandas(serve_block, _MOVES)
        rounds.append(materialize(moves, "moves"))
        if start + block < most:
            given = rounds[-1].join(units, "product_id").groupBy("product_id", c("place").alias("rank")).agg(F.sum(F.rint(c("qty") * c("unit_size"))).cast("long").alias("given"))
            sources = sources.join(given, ["product_id", "rank"], "left").withColumn("left", c("left") - F.coalesce("given", F.lit(0))).drop("given")
            sources = materialize(sources, "sources")
    none = rows.sparkSession.createDataFrame([], _MOVES)
    return reduce(DataFrame.unionByName, rounds, none).drop("place")


def propose_transfers(local: DataFrame, cfg: SupplyConfig, committed_out: DataFrame | None = None, committed_in: DataFrame | None = None) -> DataFrame:
    """Joint allocation per product. State never crosses products, and a product's group is its locations, not its lines."""
    rows = operating_reserve(local, cfg)
    for name, table in (("committed_out", committed_out), ("committed_in", committed_in)):
        if table is None:
            rows = rows.withColumn(name, F.lit(0.0))
        else:
            rows = rows.join(table.select(*KEYS, F.col("qty").alias(name)), KEYS, "left").fillna(0.0, [name])
    columns = [*KEYS, "unit", "criticality", "suggested", "stockout_day", "projected_stock", "is_dc", "region", "reserve", "committed_out", "committed_in"]
    moved = allocated(rows.select(*columns))
    target = local.select("product_id", F.col("location").alias("destination"), "product", "unit", F.col("criticality").alias("destination_criticality"),
                          F.col("coverage").alias("coverage_before"), "stockout_day", "stockout_date", "need_date", "unit_cost")
    arrival = max(1, round(cfg.internal_lead_time))
    q = F.col("stockout_day")
    return moved.join(target, ["product_id", "destination"]).select(
        "*", (F.col("qty") * F.col("unit_cost")).alias("amount"), F.date_add(F.lit(cfg.as_of), arrival).alias("arrival_date"),
        (q.isNull() | (q >= arrival)).alias("in_time"), (q - arrival).alias("slack_days"))


def balance_tracks(keys: DataFrame, openings: DataFrame, demand: DataFrame, events: DataFrame, horizon: int) -> DataFrame:
    """One row per key of `keys`: its projected balance and demand by day, from day 0 to the horizon, as an array."""
    c = F.col
    zero = F.lit(0.0)
    opening = keys.join(openings.select(*KEYS, "opening"), KEYS, "left")
    parts = opening.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(horizon))).alias("t"), F.when(c("t") == 0, F.coalesce("opening", zero)).otherwise(zero).alias("flow"), zero.alias("demand"))
    parts = parts.unionByName(events.filter(c("t") <= horizon).join(keys, KEYS, "left_semi").select(*KEYS, F.greatest(c("t"), F.lit(0)).alias("t"), c("qty").alias("flow"), zero.alias("demand")))
    parts = parts.unionByName(demand.filter(c("step") <= horizon).join(keys, KEYS, "left_semi").select(*KEYS, c("step").alias("t"), zero.alias("flow"), c("qty").alias("demand")))
    days = parts.groupBy(*KEYS, "t").agg(F.sum("flow").alias("flow"), F.sum("demand").alias("demand"))
    running = Window.partitionBy(*KEYS).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("balance", F.sum(c("flow") - c("demand")).over(running))
    return days.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("t", "balance", "demand"))).alias("track"), F.sum("demand").alias("demand"))


def shifted_coverage(track: Column, demand: Column, move: Column, day: int, horizon: int) -> Column:
    """Coverage when `move` is added to a stored balance from `day` on: the rest of the projection stays as it is."""
    balance = lambda x: x["balance"] + F.when(x["t"] >= day, move).otherwise(0.0)
    short = F.get(F.filter(track, lambda x: balance(x) < -1e-9), F.lit(0))
    q = short["t"]
    left = balance(F.get(track, q - 1))
    partial = (q - 1) + F.when(short["demand"] > 0, left / short["demand"]).otherwise(0.0)
    return F.when(demand <= 0, F.lit(None)).when(q.isNull(), float(horizon)).when(q == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(partial, 2)))


def coverage_after(transfers: DataFrame, openings: DataFrame, demand: DataFrame, events: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Coverage of both ends of each transfer once it has been made.

    Every key that is an end of some transfer is projected once; a transfer only shifts the stored balance from its arrival on.
    """
    c = F.col
    arrival = max(1, round(cfg.internal_lead_time))
    ends = transfers.select("product_id", c("origin").alias("location")).union(transfers.select("product_id", "destination")).distinct()
    tracks = materialize(balance_tracks(ends, openings, demand, events, cfg.horizon), "balance-tracks")
    out = transfers
    for end, move, name in (("destination", c("qty"), "coverage_after"), ("origin", -c("qty"), "origin_coverage_after")):
        side = tracks.select("product_id", c("location").alias(end), c("track").alias("_track"), c("demand").alias("_demand"))
        out = out.join(side, ["product_id", end], "left").withColumn(name, shifted_coverage(c("_track"), c("_demand"), move, arrival, cfg.horizon)).drop("_track", "_demand")
    return out.select(*transfers.columns, "coverage_after", "origin_coverage_after")
