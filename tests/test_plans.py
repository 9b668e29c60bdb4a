"""Both runs end to end over the derived tables, their reports, and a hot group of copies."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from catalogue.supply import CFG, wh_pending
from catalogue.views import Tables
from stockwarden.config import ConsumptionConfig, SupplyConfig
from stockwarden.operators import rules
from stockwarden.plans.consumption_run import run_consumption
from stockwarden.plans.reports import consumption_report, supply_report
from stockwarden.plans.supply_run import run_supply
from stockwarden.sources.stock import usable_stock

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def supply(tables):
    stock = usable_stock(tables.quants, datetime(2001, 8, 1))
    return run_supply(tables.history, stock, wh_pending(tables), tables.schedule, CFG)


def test_supply_run(supply):
    plan = supply["plan"]
    assert {r["level"] for r in plan.select("level").distinct().collect()} == {"local", "network"}
    assert plan.groupBy("product_id", "location").count().filter("count > 1").count() == 0
    assert supply["forecasts"].filter("projected < forecast or projected < agenda or lower < 0").count() == 0
    per_key = supply["forecasts"].groupBy("product_id", "location").count()
    assert per_key.filter(F.col("count") != CFG.horizon).count() == 0
    assert {r["abc"] for r in supply["abc_xyz"].select("abc").collect()} <= {"A", "B", "C"}
    given = supply["transfers"].groupBy("product_id", F.col("origin").alias("location")).agg(F.sum("qty").alias("given"))
    assert given.join(plan, ["product_id", "location"]).filter("given > projected_stock + 1e-6").count() == 0


def test_network_is_the_sum_of_locations(supply):
    local = supply["plan"].filter("level = 'local'").groupBy("product_id").agg(F.sum("daily_demand").alias("d"))
    both = supply["plan"].filter("level = 'network'").join(local, "product_id")
    assert both.filter(F.abs(F.col("d") - F.col("daily_demand")) > 1e-9).count() == 0


def test_supply_report(spark, supply, tmp_path):
    manifest = {r["name"]: r for r in supply_report(supply, str(tmp_path)).collect()}
    assert all(r["complete"] for r in manifest.values()) and len(manifest) == 13
    daily = spark.read.parquet(str(tmp_path / "daily_by_product"))
    assert daily.select("day").distinct().count() == CFG.horizon and daily.count() == daily.select("day", "item").distinct().count()
    items = [r["item"] for r in daily.select("item").distinct().collect()]
    supply_report(supply, str(tmp_path / "wide"), columns=items)
    wide = spark.read.parquet(str(tmp_path / "wide" / "daily_by_product"))
    assert wide.count() == CFG.horizon and set(items) < set(wide.columns)


def test_committed_stock_is_not_given_twice(spark, tables, supply):
    stock = usable_stock(tables.quants, datetime(2001, 8, 1))
    promised = supply["transfers"].groupBy("product_id", F.col("origin").alias("location")).agg(F.sum("qty").alias("qty"))
    covered = supply["transfers"].groupBy("product_id", F.col("destination").alias("location")).agg(F.sum("qty").alias("qty"))
    again = run_supply(tables.history, stock, wh_pending(tables), tables.schedule, CFG, committed_out=promised, committed_in=covered)
    both = again["transfers"].groupBy("product_id", F.col("origin").alias("location")).agg(F.sum("qty").alias("second")).join(promised, ["product_id", "location"])
    free = both.join(supply["plan"].filter("level = 'local'"), ["product_id", "location"])
    assert free.filter("second + qty > projected_stock + 1e-6").count() == 0
    repeated = again["transfers"].join(supply["transfers"].select("product_id", "destination"), ["product_id", "destination"], "left_semi")
    assert repeated.agg(F.sum("qty")).first()[0] is None or repeated.count() <= supply["transfers"].count()


def test_consumption_report(tables, tmp_path):
    run = run_consumption(tables.consumption, ConsumptionConfig(), with_forest=False)
    manifest = {r["name"]: r for r in consumption_report(run, str(tmp_path), "csv").collect()}
    assert manifest["findings"]["rows_written"] == run["findings"].count() and "risk_technician" in manifest


def test_hot_group_of_copies(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("L"), F.lpad("id", 6, "0")).alias("line_id"), F.when(F.col("id") < 1000, "HOT").otherwise(F.concat(F.lit("C"), "id")).alias("case_no"), F.lit(1).cast("bigint").alias("product_id"),
        F.lit(5.0).alias("qty"), F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz").alias("ts"))
    found = [r["line_id"] for r in rules.duplicates(rows, ConsumptionConfig()).select("line_id").collect()]
    assert len(found) == 999 and "L000000" not in found


def test_few_demand_days_are_insufficient(spark, tables):
    cfg = SupplyConfig(as_of=date(2001, 8, 1), dimension="warehouse", min_demand_days=10_000)
    stock = usable_stock(tables.quants, datetime(2001, 8, 1))
    plan = run_supply(tables.history, stock, wh_pending(tables), tables.schedule, cfg)["plan"]
    assert {r["method"] for r in plan.filter("level = 'local'").select("method").distinct().collect()} <= {"insufficient", "no local consumption"}


def test_only_lines_with_a_repeated_hash_are_compared(spark, monkeypatch):
    rows = [("a", "C1", 1, 2.0, 5), ("b", "C1", 1, 2.0, 5), ("c", "C1", 1, 2.0, 6), (None, "C1", 1, 2.0, 5), ("d", None, 1, 2.0, 5), ("e", None, 1, 2.0, 5), ("f", "C2", 1, 0.0, 5), ("g", "C2", 1, -0.0, 5),
            ("h", "C3", 1, float("nan"), 5), ("i", "C3", 1, float("nan"), 5), ("j", "C4", None, 1.0, 5), ("k", "C4", None, 1.0, 5), ("b", "C1", 1, 2.0, 5)]
    rows += [(f"x{k:03d}", f"X{k}", 1, 2.0, 5) for k in range(500)]
    lines = spark.createDataFrame(rows, "line_id string, case_no string, product_id long, qty double, t int").selectExpr(
        "line_id", "case_no", "product_id", "qty", "cast(timestamp_seconds(t) as timestamp_ntz) as ts")
    held, old = {}, rules.materialize
    monkeypatch.setattr(rules, "materialize", lambda df, name: held.setdefault(name, old(df, name)))
    found = sorted(r["line_id"] for r in rules.duplicates(lines, ConsumptionConfig()).select("line_id").collect())
    assert found == ["b", "b", "g", "i"]
    assert held["repeated-lines"].count() == 8
