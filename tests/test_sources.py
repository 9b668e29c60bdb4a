"""Assembly of lines, units, pending supply, guards and completeness of exports."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stockwarden.sources import catalog, consumption, stock, supply, tables

NTZ = "timestamp_ntz"


@pytest.fixture(scope="module")
def assembled(spark):
    lines = spark.createDataFrame(
        [("1", 10, "", None, 7, "agent", None, None, 21.5, "mL", 0.0, "", "", "", "", None), ("2", 11, "", None, 7, "agent", 8, "agent B", 5.0, "mL", 0.0, "", "", "", "", None), ("3", 12, "", None, 7, "agent", None, None, 5.0, "mL", 0.0, "", "", "", "", None)],
        f"line_id string, case_id bigint, case_no string, ts {NTZ}, product_id bigint, product string, effective_product_id bigint, effective_product string, qty double, unit string, amount double, hospital string, doctor string, technician string, sublocation string, duration_min double")
    headers = spark.createDataFrame(
        [(10, "F10", "done", datetime(2026, 7, 1), datetime(2026, 7, 2), 8.5, 10.25, None, None, "Dr A", "T A", "NORTH", "NORTH/OR", 90), (11, "F11", "done", datetime(2026, 7, 1), datetime(2026, 7, 2), 23.5, 1.0, None, None, "Dr A", "T A", "NORTH", "NORTH/OR", 91),
         (12, "F12", "cancel", datetime(2026, 7, 1), datetime(2026, 7, 2), 8.0, 9.0, None, None, "Dr A", "T A", "NORTH", "NORTH/OR", 92)],
        f"case_id bigint, case_no string, state string, registered {NTZ}, surgery_day {NTZ}, start_hour double, end_hour double, start_ts {NTZ}, end_ts {NTZ}, doctor string, technician string, hospital string, sublocation string, picking_id bigint")
    moves = spark.createDataFrame([("m2", 90, 7, "L-2", None), ("m1", 90, 7, "L-1", None), ("m3", 91, 8, "L-8", None)], f"move_id string, picking_id bigint, product_id bigint, lot string, expiry {NTZ}")
    costs = spark.createDataFrame([(7, 12.4, "mL"), (8, 2.0, "mL")], "product_id bigint, standard_cost double, base_unit string")
    return {r["line_id"]: r for r in consumption.clinical_consumption(lines, headers, moves, costs).collect()}


def test_time_and_duration(assembled):
    assert assembled["1"]["ts"] == datetime(2026, 7, 2, 8, 30) and assembled["1"]["duration_min"] == 105.0
    assert assembled["2"]["duration_min"] == 90.0  # across midnight


def test_lot_variant_cost_and_cancelled(assembled):
    assert assembled["1"]["lot"] == "L-1" and assembled["2"]["product_id"] == 8 and assembled["2"]["lot"] == "L-8"
    assert assembled["1"]["amount"] == pytest.approx(round(21.5 * 12.4, 2)) and assembled["1"]["amount_estimated"]
    assert "3" not in assembled


UNITS = "unit_id bigint, name string, rounding double, factor double, parent_id bigint, relative_factor double"


def test_unit_chain_and_cycle(spark):
    units = spark.createDataFrame([(1, "mL", 0.1, None, None, 1.0), (2, "bottle", 1.0, None, 1, 250.0), (3, "case", 1.0, None, 2, 10.0), (4, "a", 1.0, None, 5, 2.0), (5, "b", 1.0, None, 4, 3.0)], UNITS)
    got = {r["name"]: r["factor"] for r in catalog.absolute_factors(units).collect()}
    assert got["mL"] == 1.0 and got["bottle"] == pytest.approx(1 / 250) and got["case"] == pytest.approx(1 / 2500)
    assert got["a"] == pytest.approx(1 / 6) and got["b"] == pytest.approx(1 / 6)


def test_unit_chains_of_any_depth_and_cycles_with_tails(spark):
    chain = [(k, f"u{k}", 1.0, None, k - 1 if k else None, 1.0 if not k else 2.0) for k in range(41)]
    ring = [(100 + k, f"r{k}", 1.0, None, 100 + (k + 1) % 3, 2.0 + k) for k in range(3)] + [(200, "tail", 1.0, None, 100, 10.0), (201, "end", 1.0, None, 200, 7.0), (300, "lost", 1.0, None, 999, 4.0), (301, "self", 1.0, None, 301, 5.0), (302, "stored", 1.0, 3.0, 0, 9.0), (303, "below", 1.0, None, 302, 2.0)]
    got = {r["name"]: r["factor"] for r in catalog.absolute_factors(spark.createDataFrame(chain + ring, UNITS)).collect()}
    assert all(got[f"u{k}"] == pytest.approx(2.0**-k) for k in range(41))
    assert all(got[f"r{k}"] == pytest.approx(1 / 24) for k in range(3)) and got["tail"] == pytest.approx(1 / 240) and got["end"] == pytest.approx(1 / 1680)
    assert got["lost"] == 0.25 and got["self"] == 0.2 and got["stored"] == 3.0 and got["below"] == 1.5


def test_many_units(spark):
    units = spark.range(300_000).selectExpr("id as unit_id", "concat('u', id) as name", "1d as rounding", "cast(null as double) as factor", "if(id = 0, null, id div 10) as parent_id", "if(id = 0, 1d, 2d) as relative_factor")
    got = catalog.absolute_factors(units)
    assert got.count() == 300_000
    assert got.filter("unit_id = 299999").first()["factor"] == pytest.approx(2.0**-6)


def test_lines_without_a_header_stay(spark):
    lines = spark.createDataFrame([("a", 1, "", 5.0, "W"), ("b", 2, "C9", 6.0, ""), ("c", 3, "", 7.0, "")], "line_id string, case_id bigint, case_no string, duration_min double, hospital string").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    heads = spark.createDataFrame([(1, "H1", "done", "N"), (3, "H3", "cancel", "N")], "case_id bigint, case_no string, state string, hospital string")
    for name, kind in (("picking_id", "bigint"), ("surgery_day", "timestamp_ntz"), ("registered", "timestamp_ntz"), ("start_ts", "timestamp_ntz"), ("end_ts", "timestamp_ntz"), ("start_hour", "double"), ("end_hour", "double")):
        heads = heads.withColumn(name, F.lit(None).cast(kind))
    got = {r["line_id"]: (r["case_no"], r["hospital"], r["duration_min"]) for r in consumption.with_headers(lines, heads).collect()}
    assert got == {"a": ("H1", "W", 5.0), "b": ("C9", "", 6.0)}


def test_purchase_unit_from_supplier_and_missing_conversion(spark):
    units = spark.createDataFrame([(1, "mL", 0.1, 1.0, None, None), (2, "bottle", 1.0, 1 / 250, None, None)], UNITS)
    products = spark.createDataFrame([(1, 100, 1, True), (2, 200, 1, True), (3, 300, 1, True)], "product_id bigint, template_id bigint, base_unit_id bigint, active boolean")
    suppliers = spark.createDataFrame([(1, 1, 100, 5, 2, 9.0), (2, None, 200, 1, 2, 4.0), (3, 3, 300, 1, 99, 4.0)], "id bigint, product_id bigint, template_id bigint, sequence int, unit_id bigint, delay double")
    got = {r["product_id"]: r["ratio"] for r in catalog.purchase_units(products, suppliers, catalog.absolute_factors(units)).collect()}
    assert got[1] == pytest.approx(250.0) and got[2] == pytest.approx(250.0) and got[3] is None


def test_purchase_counts_once_in_base_units(spark):
    factors = spark.createDataFrame([("mL", 1.0), ("bottle", 1 / 250)], "name string, factor double")
    base = spark.createDataFrame([(1, "mL")], "product_id bigint, base_unit string")
    lines = spark.createDataFrame([(5, 1, 14.0, 2.0, "purchase", datetime(2026, 7, 20), "bottle")], f"order_id bigint, product_id bigint, ordered double, received double, state string, planned {NTZ}, unit_doc string")
    orders = spark.createDataFrame([(5, "PO5", "ACME", 1, "purchase", datetime(2026, 7, 20))], f"order_id bigint, order_ref string, supplier string, receipt_type_id bigint, order_state string, planned {NTZ}")
    types = spark.createDataFrame([(1, "DC/STOCK")], "receipt_type_id bigint, to_location string")
    moves = spark.createDataFrame([("IN5", 1, 12.0, 3000.0, "bottle", "DC/STOCK", "SUPPLIER", datetime(2026, 7, 20), "assigned", "supplier", "internal")],
                                  f"ref string, product_id bigint, qty_doc double, base_qty double, unit_doc string, to_location string, from_location string, due_at {NTZ}, state string, from_usage string, to_usage string")
    now = datetime(2026, 8, 1)
    rows = supply.pending_supply(supply.pending_purchases(lines, orders, types, base, factors, now), supply.pending_transfers(moves, base, factors, now)).collect()
    assert len(rows) == 1 and rows[0]["qty"] == 3000.0 and rows[0]["late"] and rows[0]["to_location"] == "DC/STOCK"


def test_usable_stock(spark):
    quants = spark.createDataFrame([(1, "a", "N/OR", "", "L1", datetime(2026, 1, 1), 10.0, 2.0), (1, "a", "N/OR", "", "L2", None, 10.0, 12.0), (1, "a", "N/OR", "", "L3", None, 10.0, 4.0)],
                                   f"product_id bigint, product string, location string, warehouse string, lot string, expiry {NTZ}, qty double, reserved double")
    got = {r["lot"]: r for r in stock.usable_stock(quants, datetime(2026, 8, 1)).collect()}
    assert got["L1"]["usable"] == 0.0 and got["L1"]["available"] == 8.0 and got["L2"]["usable"] == 0.0 and got["L3"]["usable"] == 6.0 and got["L3"]["warehouse"] == "N"


def test_guards(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id bigint, patient_name string, display_name string")
    assert tables.without_guarded(df).columns == ["id", "display_name"]
    assert tables.query_table(df, "cases", fields=["patient_name"]).columns == ["display_name"]
    assert tables.query_table(df, "cases", group_by=["patient_name", "id"]).columns == ["id", "records"]
    with pytest.raises(ValueError):
        tables.query_table(df, "cases", terms=[("patient_name", "=", "x")])
    with pytest.raises(ValueError):
        tables.query_table(df, "res.users")


def test_predicates(spark):
    df = spark.range(10).withColumn("name", F.concat(F.lit("N"), "id"))
    ids = lambda terms: sorted(r["id"] for r in df.filter(tables.condition(terms)).collect())
    assert ids(["|", ("id", "=", 1), ("name", "ilike", "n7")]) == [1, 7]
    assert ids([("id", ">", 2), ("id", "<=", 5), ("id", "not in", [4])]) == [3, 5]
    assert ids(["|", ("id", "=", 1), "|", ("id", "=", 2), ("id", "=", 3)]) == [1, 2, 3]


def test_export_declares_truncation(spark, tmp_path):
    out = {r["name"]: r for r in tables.write_report({"all": spark.range(5), "cut": spark.range(50)}, str(tmp_path / "r"), max_rows=20).collect()}
    assert out["all"]["complete"] and not out["cut"]["complete"] and out["cut"]["rows_written"] == 20 and out["cut"]["rows_total"] == 50
    assert spark.read.parquet(str(tmp_path / "r" / "cut")).count() == 20


def test_profile_merge_keeps_adjustment(spark):
    old = spark.createDataFrame([("product", "1", "qty", 5, 1.0, 0.3), ("product", "2", "qty", 5, 1.0, -0.15)], "scope string, key string, metric string, n bigint, mean double, threshold_adj double")
    new = spark.createDataFrame([("product", "1", "qty", 9, 2.0), ("product", "3", "qty", 4, 3.0)], "scope string, key string, metric string, n bigint, mean double")
    got = {r["key"]: r for r in tables.merge_profiles(old, new).collect()}
    assert (got["1"]["n"], got["1"]["threshold_adj"]) == (9, 0.3) and got["2"]["n"] == 5 and got["3"]["threshold_adj"] == 0.0


def test_window_defaults():
    assert consumption.window(None, date(2026, 7, 1), datetime(2026, 8, 1))[1] == datetime(2026, 7, 1, 23, 59, 59)
    assert consumption.window(None, None, datetime(2026, 8, 1), 30)[0] == datetime(2026, 7, 2)
