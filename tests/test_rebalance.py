"""Joint allocation: nothing is promised twice, reserves and commitments stay."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.operators.rebalance import allocated, operating_reserve, propose_transfers

CFG = SupplyConfig(as_of=date(2026, 8, 1))
SCHEMA = ("product_id bigint, product string, location string, unit string, criticality string, suggested double, stockout_day int, stock double, projected_stock double, "
          "daily_demand double, horizon_demand double, reorder_point double, is_dc boolean, unit_cost double, coverage double, stockout_date date, need_date date")


def row(location, criticality, suggested=0.0, stock=0.0, daily=0.0, dc=False, stockout=None, product=1, unit="pc"):
    return (product, "item", location, unit, criticality, float(suggested), stockout, float(stock), float(stock), float(daily), 30.0 * float(daily), 7.0 * float(daily), dc, 2.0, None, None, None)


def plan(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def two_needs(source_daily=0.0):
    return [row("NORTH/A", "out_of_stock", 300, 0, 5, stockout=1), row("NORTH/B", "critical", 250, 0, 5, stockout=3), row("CEDIS-NORTH", "source", 0, 400, source_daily, dc=True)]


def test_one_source_is_shared(spark):
    cfg = SupplyConfig(as_of=CFG.as_of, dc_reserve_days=0)
    got = {r["destination"]: r["qty"] for r in propose_transfers(plan(spark, *two_needs()), cfg).collect()}
    assert got == {"NORTH/A": 300.0, "NORTH/B": 100.0}


def test_reserve_is_kept(spark):
    rows = [row("NORTH/A", "out_of_stock", 300, 0, 40, stockout=1), row("CEDIS-NORTH", "source", 0, 400, dc=True)]
    got = propose_transfers(plan(spark, *rows), CFG).collect()
    assert sum(r["qty"] for r in got) == 120.0 and got[0]["reserve"] == 280.0


def test_commitments_are_deducted(spark):
    cfg = SupplyConfig(as_of=CFG.as_of, dc_reserve_days=0)
    taken = spark.createDataFrame([(1, "CEDIS-NORTH", 150.0)], "product_id bigint, location string, qty double")
    covered = spark.createDataFrame([(1, "NORTH/A", 280.0)], "product_id bigint, location string, qty double")
    got = propose_transfers(plan(spark, *two_needs()), cfg, taken, covered).collect()
    assert sum(r["qty"] for r in got) <= 250.0
    assert {r["destination"]: r["qty"] for r in got}["NORTH/A"] == 20.0


def test_same_region_first_and_whole_units(spark):
    cfg = SupplyConfig(as_of=CFG.as_of, dc_reserve_days=0)
    rows = [row("SOUTH/A", "critical", 10.4, 0, 1, stockout=2), row("NORTH/X", "excess", 0, 500), row("SOUTH/X", "ok", 0, 4.9)]
    got = {r["origin"]: r["qty"] for r in propose_transfers(plan(spark, *rows), cfg).collect()}
    assert got == {"SOUTH/X": 4.0, "NORTH/X": 7.0}


def test_never_more_than_available(spark):
    rng = np.random.default_rng(5)
    rows = []
    for product in range(12):
        for i in range(8):
            need = rng.random() < 0.5
            rows.append(row(f"{'NORTH' if i % 2 else 'SOUTH'}/{i}", "critical" if need else "excess", rng.integers(1, 90) if need else 0, 0 if need else rng.integers(0, 120), rng.integers(0, 3),
                            stockout=int(rng.integers(1, 9)) if need else None, product=product))
    source = plan(spark, *rows)
    cfg = SupplyConfig(as_of=CFG.as_of)
    got = propose_transfers(source, cfg)
    given = got.groupBy("product_id", F.col("origin").alias("location")).agg(F.sum("qty").alias("given"), F.max("reserve").alias("reserve")).join(source, ["product_id", "location"])
    assert given.filter("given > projected_stock - reserve + 1e-6").count() == 0
    taken = got.groupBy("product_id", F.col("destination").alias("location")).agg(F.sum("qty").alias("given")).join(source, ["product_id", "location"])
    assert taken.filter("given > ceil(suggested) + 1e-6").count() == 0
    assert got.count() > 0


@pytest.mark.parametrize("parts", [1, 5])
def test_partitioning_changes_nothing(spark, parts):
    source = plan(spark, *two_needs(), *[row(f"W/{i}", "excess", 0, 100, product=2) for i in range(4)], row("W/n", "critical", 250, stockout=2, product=2))
    cfg = SupplyConfig(as_of=CFG.as_of, dc_reserve_days=0)
    got = sorted((r["product_id"], r["origin"], r["destination"], r["qty"]) for r in propose_transfers(source.repartition(parts), cfg).collect())
    assert sum(q for p, *_, q in got if p == 2) == 250.0


def fold(rows, cfg, taken=None, covered=None):
    """One need after the other, each over all sources in its own order."""
    taken, covered, out = taken or {}, covered or {}, []
    by_product = {}
    for r in rows:
        by_product.setdefault(r["product_id"], []).append(r)
    rank = {"out_of_stock": 0, "critical": 1, "reorder": 2}
    for product, own in by_product.items():
        needs = [r for r in own if r["criticality"] in rank and r["suggested"] > 0]
        needs.sort(key=lambda r: (r["stockout_day"] is None, r["stockout_day"] or 0, rank[r["criticality"]], -r["suggested"], r["location"]))
        sources = [r for r in own if r["criticality"] in ("excess", "ok", "no_movement", "source")]
        sources.sort(key=lambda r: (0 if r["is_dc"] else 1 if r["criticality"] == "excess" else 2, -r["projected_stock"], r["location"]))
        left = [math.floor(max(0, s["projected_stock"] - s["reserve"] - taken.get((product, s["location"]), 0)) + 1e-9) for s in sources]
        for need in needs:
            missing = math.ceil(max(0, need["suggested"] - covered.get((product, need["location"]), 0)) - 1e-9)
            turn = sorted(range(len(sources)), key=lambda i: (sources[i]["region"] != need["region"], i))
            for i in turn:
                qty = min(missing, left[i])
                if qty > 0:
                    out.append((product, sources[i]["location"], need["location"], float(qty), float(left[i])))
                    left[i] -= qty
                    missing -= qty
    return sorted(out)


def many_places(seed, products, places):
    rng = np.random.default_rng(seed)
    rows = []
    for product in range(products):
        for i in range(places):
            need, region = rng.random() < 0.5, ["NORTH", "SOUTH", "EAST", "WEST"][rng.integers(0, 4)]
            state = rng.choice(["out_of_stock", "critical", "reorder"]) if need else rng.choice(["excess", "ok", "no_movement"])
            rows.append(row(f"{region}/{i}", state, rng.integers(1, 60) if need else 0, 0 if need else rng.integers(0, 70), 0,
                            stockout=int(rng.integers(1, 9)) if need and rng.random() < 0.8 else None, product=product))
    return rows


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_rounds_equal_one_need_after_the_other(spark, block):
    cfg = SupplyConfig(as_of=CFG.as_of)
    placed = operating_reserve(plan(spark, *many_places(3, 6, 24)), cfg).withColumns({"committed_out": F.lit(0.0), "committed_in": F.lit(0.0)})
    got = sorted((r["product_id"], r["origin"], r["destination"], r["qty"], r["free_before"]) for r in allocated(placed, block).collect())
    assert got == fold([r.asDict() for r in placed.collect()], cfg)


def test_a_product_with_very_many_places(spark):
    cfg = SupplyConfig(as_of=CFG.as_of)
    placed = operating_reserve(plan(spark, *many_places(4, 1, 4000)), cfg).withColumns({"committed_out": F.lit(0.0), "committed_in": F.lit(0.0)})
    got = sorted((r["product_id"], r["origin"], r["destination"], r["qty"], r["free_before"]) for r in allocated(placed, 600).collect())
    assert got == fold([r.asDict() for r in placed.collect()], cfg)


def test_needs_without_sources(spark):
    rows = [row("NORTH/A", "critical", 10, 0, 1, stockout=2), row("SOUTH/B", "ok", 0, 50, product=2)]
    assert propose_transfers(plan(spark, *rows), CFG).count() == 0
