"""Scans, cleaning, units, pending supply, billing and the expressions they use."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue.registry import CTES, query
from stockwarden.functions import dates, maths, text
from stockwarden.operators.adhoc import price_by_longest_prefix, usage_by_period
from stockwarden.operators.features import is_volatile, line_features
from stockwarden.schema import clean_doubles, map_columns, split_reference
from stockwarden.sources import billing, catalog, consumption, stock, supply, tables

AS_OF = datetime(2001, 8, 1)

# ── scans ────────────────────────────────────────────────────────────────────────────────────────────────────


@query("S01_consumption_window", """
SELECT line_id, ts, hospital, product_id, qty, amount FROM {consumption}
WHERE ts >= TIMESTAMP '2000-01-01 00:00:00' AND ts <= TIMESTAMP '2000-06-30 23:59:59'
  AND product_id IN (0, 3, 7) AND hospital IN ('NATION_1', 'NATION_3')""", "qty amount:2")
def _(t):
    bounds = consumption.window(date(2000, 1, 1), date(2000, 6, 30), AS_OF)
    rows = consumption.consumption_lines(t.consumption, bounds, [0, 3, 7], ["NATION_1", "NATION_3"])
    return rows.select("line_id", "ts", "hospital", "product_id", "qty", "amount")


CTES["first_lot"] = """
SELECT picking_id, product_id, lot, expiry FROM (
  SELECT *, row_number() OVER (PARTITION BY picking_id, product_id ORDER BY move_id) AS rn FROM {raw_moves} WHERE trim(lot) <> '') WHERE rn = 1
"""

CTES["headed"] = """
SELECT l.line_id, l.case_id, coalesce(h.case_no, l.case_no) AS case_no, h.picking_id,
       coalesce(l.effective_product_id, l.product_id) AS product_id,
       CASE WHEN l.effective_product_id IS NOT NULL THEN coalesce(nullif(l.effective_product, ''), l.product) ELSE l.product END AS product,
       l.qty, l.unit, l.amount,
       coalesce(nullif(l.hospital, ''), nullif(h.hospital, ''), '') AS hospital, coalesce(nullif(l.doctor, ''), nullif(h.doctor, ''), '') AS doctor,
       coalesce(nullif(l.technician, ''), nullif(h.technician, ''), '') AS technician, coalesce(nullif(l.sublocation, ''), nullif(h.sublocation, ''), '') AS sublocation,
       CASE WHEN coalesce(h.surgery_day, h.registered) IS NOT NULL AND h.start_hour > 0
            THEN coalesce(h.surgery_day, h.registered) + INTERVAL '1' MINUTE * CAST(h.start_hour * 60 AS INT)
            ELSE coalesce(h.start_ts, h.surgery_day, h.registered) END AS ts,
       CASE WHEN h.start_hour > 0 AND h.end_hour > 0 AND h.end_hour <> h.start_hour
            THEN (h.end_hour - h.start_hour) * 60 + CASE WHEN h.end_hour < h.start_hour THEN 1440 ELSE 0 END
            WHEN h.start_ts IS NOT NULL THEN 95.0e0 ELSE l.duration_min END AS duration_min
FROM {raw_lines} l LEFT JOIN {raw_headers} h ON h.case_id = l.case_id
WHERE h.state IS NULL OR h.state NOT IN ('cancel', 'cancelled', 'cancelado')
"""

CTES["assembled"] = """
SELECT d.line_id, d.ts, CAST(d.ts AS DATE) AS day, d.case_id, d.case_no, d.hospital, d.doctor, d.technician, d.sublocation,
       split_part(d.sublocation, '/', 1) AS warehouse, d.product_id, d.product, coalesce(f.lot, '') AS lot, f.expiry, d.qty, d.unit,
       ROUND(d.qty * c.standard_cost, 2) AS amount, c.standard_cost > 0 AS amount_estimated, d.duration_min
FROM {headed} d LEFT JOIN {first_lot} f ON f.picking_id = d.picking_id AND f.product_id = d.product_id
JOIN {costs} c ON c.product_id = d.product_id WHERE d.qty <> 0 AND d.ts IS NOT NULL
"""


@query("S01_clinical_assembly", "SELECT * FROM {assembled}", "qty amount:1 duration_min")
def _(t):
    rows = consumption.clinical_consumption(t.raw_lines, t.raw_headers, t.raw_moves, t.costs)
    return rows.drop("weight_start", "weight_end", "measured_ml", "weighable", "source")


@query("S02_fallback_consumption", """
SELECT m.move_id AS line_id, m.ts, m.reference AS case_no, m.to_location AS hospital, m.from_location AS sublocation,
       split_part(m.from_location, '/', 1) AS warehouse, m.product_id, m.lot, m.qty, m.unit,
       CASE WHEN m.unit = c.base_unit THEN ROUND(m.qty * c.standard_cost, 2) ELSE 0 END AS amount,
       m.unit = c.base_unit AS amount_estimated, 'stock_moves' AS source
FROM {raw_moves} m JOIN {costs} c ON c.product_id = m.product_id
WHERE m.state = 'done' AND m.from_usage = 'internal' AND m.to_usage IN ('customer', 'production', 'inventory', 'transit')""", "qty amount:1")
def _(t):
    rows = consumption.fallback_consumption(t.raw_moves, t.costs)
    return rows.select("line_id", "ts", "case_no", "hospital", "sublocation", "warehouse", "product_id", "lot", "qty", "unit",
                       "amount", "amount_estimated", "source")


@query("S03_product_catalogue", "SELECT product_id, name, kind FROM {products} WHERE active AND kind IN ('product', 'consu')")
def _(t):
    return catalog.products(t.products).select("product_id", "name", "kind")


@query("S04_warehouses", "SELECT DISTINCT warehouse FROM {quants}")
def _(t):
    return t.quants.select("warehouse").distinct()


@query("S05_internal_locations", "SELECT DISTINCT location, warehouse FROM {quants} WHERE usage = 'internal'")
def _(t):
    return catalog.locations(t.quants).select("location", "warehouse").distinct()


@query("S06_medical_units", "SELECT c_custkey AS id, c_name AS name FROM {customer} WHERE c_mktsegment = 'MACHINERY'")
def _(t):
    partners = t.customer.withColumn("is_medical_unit", F.col("c_mktsegment") == "MACHINERY")
    return catalog.medical_units(partners, "is_medical_unit").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


CTES["stock"] = """
SELECT product_id, product, location, warehouse, lot, expiry, qty, reserved, greatest(0.0e0, qty - reserved) AS available,
       expiry < TIMESTAMP '2001-08-01 00:00:00' AS expired,
       CASE WHEN expiry < TIMESTAMP '2001-08-01 00:00:00' THEN 0.0e0 ELSE greatest(0.0e0, qty - reserved) END AS usable
FROM {quants} WHERE usage = 'internal'
"""


@query("S07_usable_stock", "SELECT * FROM {stock}", "qty reserved available usable")
def _(t):
    return stock.usable_stock(t.quants, AS_OF)


CTES["unit_walk"] = """
SELECT unit_id AS start_id, unit_id AS at_id, 1.0e0 AS divisor, 0 AS depth FROM {units}
UNION ALL
SELECT w.start_id, u.unit_id, w.divisor * coalesce(c.relative_factor, 1.0e0), w.depth + 1
FROM unit_walk w JOIN {units} c ON c.unit_id = w.at_id JOIN {units} u ON u.unit_id = c.parent_id
WHERE c.factor IS NULL AND c.parent_id <> c.unit_id AND w.depth < 32
"""

CTES["unit_factors"] = """
SELECT w.start_id AS unit_id, s.name, s.rounding, coalesce(e.factor, 1.0e0 / coalesce(e.relative_factor, 1.0e0)) / w.divisor AS factor
FROM {unit_walk} w JOIN {units} e ON e.unit_id = w.at_id JOIN {units} s ON s.unit_id = w.start_id
WHERE w.depth = (SELECT max(depth) FROM {unit_walk} x WHERE x.start_id = w.start_id)
"""


@query("S08_units_absolute_factor", "SELECT unit_id, name, rounding, factor FROM {unit_factors}", "rounding factor:9")
def _(t):
    return catalog.absolute_factors(t.units)


CTES["pending_raw"] = """
SELECT 'purchase' AS kind, o.order_ref AS ref, o.supplier, l.product_id,
       ROUND(coalesce((l.ordered - l.received) / fd.factor * fb.factor, l.ordered - l.received), 3) AS qty, l.ordered - l.received AS qty_doc, l.unit_doc,
       coalesce(r.to_location, '') AS to_location, o.supplier AS from_location, coalesce(l.planned, o.planned) AS due_at, TRUE AS confirmed,
       coalesce(l.planned, o.planned) < TIMESTAMP '2001-08-01 00:00:00' AS late
FROM {purchase_lines} l LEFT JOIN {purchase_orders} o ON o.order_id = l.order_id LEFT JOIN {receipt_types} r ON r.receipt_type_id = o.receipt_type_id
LEFT JOIN {unit_factors} fd ON fd.name = l.unit_doc LEFT JOIN {base_units} b ON b.product_id = l.product_id LEFT JOIN {unit_factors} fb ON fb.name = b.base_unit
WHERE l.state IN ('purchase', 'done') AND l.ordered - l.received > 0 AND o.order_state NOT IN ('cancel', 'draft', 'sent', 'to approve')
UNION ALL
SELECT 'transfer', m.ref, '', m.product_id, coalesce(nullif(m.base_qty, 0), ROUND(coalesce(m.qty_doc / fd.factor * fb.factor, m.qty_doc), 3)), m.qty_doc, m.unit_doc,
       m.to_location, m.from_location, m.due_at, m.state <> 'draft', m.due_at < TIMESTAMP '2001-07-31 00:00:00'
FROM {transfer_moves} m LEFT JOIN {unit_factors} fd ON fd.name = m.unit_doc LEFT JOIN {base_units} b ON b.product_id = m.product_id
LEFT JOIN {unit_factors} fb ON fb.name = b.base_unit
WHERE m.state <> 'done' AND m.from_usage = 'internal' AND m.to_usage = 'internal'
"""


@query("S09_pending_supply", "SELECT * FROM {pending_raw}", "qty:2 qty_doc")
def _(t):
    factors = catalog.absolute_factors(t.units)
    bought = supply.pending_purchases(t.purchase_lines, t.purchase_orders, t.receipt_types, t.base_units, factors, AS_OF)
    moved = supply.pending_transfers(t.transfer_moves, t.base_units, factors, AS_OF)
    return supply.pending_supply(bought, moved)


@query("S10_scheduled_cases", """
SELECT hospital, hospital_id, CAST(surgery_day AS DATE) AS day, count(*) AS cases FROM {raw_headers}
WHERE surgery_day > TIMESTAMP '2001-06-01 00:00:00' AND surgery_day <= TIMESTAMP '2001-07-01 00:00:00'
  AND state NOT IN ('cancel', 'cancelled', 'cancelado', 'done', 'closed', 'invoiced') GROUP BY 1, 2, 3""")
def _(t):
    return supply.scheduled_cases(t.raw_headers, datetime(2001, 6, 1))


@query("A04_scheduled_cases_null_group", """
SELECT CASE WHEN hospital_id % 4 <> 0 THEN hospital END AS hospital, hospital_id, CAST(surgery_day AS DATE) AS day, count(*) AS cases FROM {raw_headers}
WHERE surgery_day > TIMESTAMP '2001-04-01 00:00:00' AND surgery_day <= TIMESTAMP '2001-05-01 00:00:00'
  AND state NOT IN ('cancel', 'cancelled', 'cancelado', 'done', 'closed', 'invoiced') GROUP BY 1, 2, 3""")
def _(t):
    heads = t.raw_headers.withColumn("hospital", F.when(F.col("hospital_id") % 4 != 0, F.col("hospital")))
    return supply.scheduled_cases(heads, datetime(2001, 4, 1))


@query("S11_case_headers", """
SELECT case_no, state, hospital, technician, registered FROM {raw_headers}
WHERE registered >= TIMESTAMP '1999-01-01 00:00:00' AND registered <= TIMESTAMP '1999-03-31 23:59:59'""")
def _(t):
    bounds = consumption.window(date(1999, 1, 1), date(1999, 3, 31), AS_OF)
    heads = t.raw_headers.filter(consumption.in_window(F.col("registered"), bounds))
    return tables.without_guarded(heads.withColumn("patient_name", F.col("case_no"))).select(
        "case_no", "state", "hospital", "technician", "registered")


CTES["invoices"] = """
SELECT number, customer, date, due, state, payment_state, kind,
       subtotal * CASE WHEN kind LIKE '%refund' THEN -1 ELSE 1 END AS subtotal, total * CASE WHEN kind LIKE '%refund' THEN -1 ELSE 1 END AS total,
       balance * CASE WHEN kind LIKE '%refund' THEN -1 ELSE 1 END AS balance,
       due < DATE '2001-08-01' AND balance > 0 AND state = 'posted' AS overdue, strftime(date, '%Y-%m') AS month
FROM {account_moves} WHERE kind IN ('out_invoice', 'out_refund') AND date BETWEEN DATE '2000-08-01' AND DATE '2001-08-01' AND state <> 'cancel'
"""


def _invoices(t):
    return billing.invoices(t.account_moves, date(2000, 8, 1), date(2001, 8, 1), date(2001, 8, 1))


@query("S12_invoices", "SELECT * FROM {invoices}", "subtotal:3 total:2 balance:2")
def _(t):
    return _invoices(t)


@query("S13_invoice_lines", """
SELECT number, customer, product_id, qty, unit_price, amount, date, strftime(date, '%Y-%m') AS month FROM {account_lines}
WHERE kind IN ('in_invoice', 'in_refund') AND date BETWEEN DATE '1998-01-01' AND DATE '2001-08-01' AND state <> 'cancel' AND product_id IS NOT NULL""",
       "qty unit_price amount:2")
def _(t):
    return billing.invoice_lines(t.account_lines, date(1998, 1, 1), date(2001, 8, 1), "supplier")


@query("S14_table_query", """
SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 400000 AND (o_orderstatus = 'F' OR lower(o_orderpriority) LIKE '%urg%')
ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""", "o_totalprice:2")
def _(t):
    terms = [("o_totalprice", ">=", 400000), "|", ("o_orderstatus", "=", "F"), ("o_orderpriority", "ilike", "URG")]
    return tables.query_table(t.orders, "orders", terms, ["o_orderkey", "o_totalprice"], [F.desc("o_totalprice"), F.col("o_orderkey")], 50)


@query("A07_table_group_sum", "SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice, count(*) AS records FROM {orders} WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
       "o_totalprice:2")
def _(t):
    return tables.query_table(t.orders, "orders", [("o_orderstatus", "in", ["F", "P"])], group_by=["o_orderpriority"], sums=["o_totalprice"], limit=200)


# ── projections and predicates ───────────────────────────────────────────────────────────────────────────────


@query("P01_column_mapping", """
SELECT CAST(l_orderkey AS VARCHAR) AS line_id, l_shipdate AS ts, l_quantity AS qty, CAST(NULL AS VARCHAR) AS doctor FROM {lineitem}""", "qty")
def _(t):
    logical = T.StructType.fromDDL("line_id string, ts timestamp_ntz, qty double, doctor string")
    return map_columns(t.lineitem, {"line_id": "l_orderkey", "ts": "l_shipdate", "qty": "l_quantity", "doctor": "no_such_column"}, logical)


@query("P02_reference_split", """
SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS customer_id,
       CASE WHEN o_custkey % 7 <> 0 THEN concat('Customer ', o_custkey) ELSE '' END AS customer FROM {orders}""")
def _(t):
    ref = F.when(F.col("o_custkey") % 7 != 0, F.struct(F.col("o_custkey").alias("id"), F.concat(F.lit("Customer "), "o_custkey").alias("name")))
    return split_reference(t.orders.select("o_orderkey", ref.alias("customer")), "customer")


@query("P03_default_window", """
SELECT count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts FROM {consumption}
WHERE ts >= TIMESTAMP '2001-05-03 00:00:00' AND ts <= TIMESTAMP '2001-08-01 00:00:00'""")
def _(t):
    rows = t.consumption.filter(consumption.in_window(F.col("ts"), consumption.window(None, None, AS_OF, 90)))
    return rows.agg(F.count("*").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("P04_guarded_columns", "SELECT o_orderkey, o_orderstatus FROM {orders}")
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("patient_id"), F.col("o_totalprice").alias("iban"))
    return tables.without_guarded(rows)


@query("P05_effective_product", """
SELECT line_id, coalesce(effective_product_id, product_id) AS product_id,
       CASE WHEN effective_product_id IS NOT NULL THEN coalesce(nullif(effective_product, ''), product) ELSE product END AS product FROM {raw_lines}""")
def _(t):
    return consumption.effective_product(t.raw_lines).select("line_id", "product_id", "product")


@query("P06_line_over_header", "SELECT line_id, hospital, doctor, technician, sublocation FROM {headed}")
def _(t):
    rows = consumption.with_headers(consumption.effective_product(t.raw_lines), t.raw_headers)
    return rows.select("line_id", "hospital", "doctor", "technician", "sublocation")


@query("P07_warehouse_of_location", "SELECT DISTINCT sublocation, split_part(sublocation, '/', 1) AS warehouse FROM {consumption}")
def _(t):
    return t.consumption.select("sublocation", text.warehouse(F.col("sublocation")).alias("warehouse")).distinct()


@query("P08_complete_and_clean", """
SELECT line_id, ts, product_id, coalesce(lot, '') AS lot, TRY_CAST(raw_qty AS DOUBLE) AS qty FROM (
  SELECT *, CASE WHEN l_linenumber = 4 THEN 'n/a' WHEN l_linenumber = 5 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS raw_qty,
         CASE WHEN l_linenumber = 6 THEN NULL ELSE l_shipdate END AS ts, concat(l_orderkey, '-', l_linenumber) AS line_id, CAST(NULL AS VARCHAR) AS lot,
         l_partkey % 16 AS product_id FROM {lineitem})
WHERE ts IS NOT NULL AND coalesce(TRY_CAST(raw_qty AS DOUBLE), 0) <> 0""", "qty")
def _(t):
    ln = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("line_id"),
        F.when(ln == 6, F.lit("not a date")).otherwise(F.col("l_shipdate").cast("string")).alias("ts"),
        F.when(ln == 4, "n/a").when(ln == 5, "0").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty"),
        (F.col("l_partkey") % 16).alias("product_id"))
    return consumption.complete(rows).select("line_id", "ts", "product_id", "lot", "qty")


@query("P09_usable_quantity", "SELECT location, sum(available) AS available, sum(usable) AS usable, count(*) FILTER (expired) AS expired_lots FROM {stock} GROUP BY 1",
       "available usable")
def _(t):
    rows = stock.usable_stock(t.quants, AS_OF)
    return rows.groupBy("location").agg(F.sum("available").alias("available"), F.sum("usable").alias("usable"), F.count_if("expired").alias("expired_lots"))


@query("P10_overdue_and_sign", "SELECT overdue, kind, count(*) AS n, sum(balance) AS balance FROM {invoices} GROUP BY 1, 2", "balance:2")
def _(t):
    return _invoices(t).groupBy("overdue", "kind").agg(F.count("*").alias("n"), F.sum("balance").alias("balance"))


@query("P11_confirmed_late", "SELECT kind, confirmed, late, count(*) AS n, sum(qty_doc) AS qty_doc FROM {pending_raw} GROUP BY 1, 2, 3", "qty_doc")
def _(t):
    factors = catalog.absolute_factors(t.units)
    bought = supply.pending_purchases(t.purchase_lines, t.purchase_orders, t.receipt_types, t.base_units, factors, AS_OF)
    moved = supply.pending_transfers(t.transfer_moves, t.base_units, factors, AS_OF)
    return supply.pending_supply(bought, moved).groupBy("kind", "confirmed", "late").agg(F.count("*").alias("n"), F.sum("qty_doc").alias("qty_doc"))


@query("P12_scheduled_states", """
SELECT state, count(*) AS n FROM {raw_headers} WHERE surgery_day > TIMESTAMP '2001-01-01 00:00:00' AND surgery_day <= TIMESTAMP '2001-01-31 00:00:00'
  AND state NOT IN ('cancel', 'cancelled', 'cancelado', 'done', 'closed', 'invoiced') GROUP BY 1""")
def _(t):
    rows = supply.scheduled_cases(t.raw_headers.withColumn("hospital", F.col("state")), datetime(2001, 1, 1))
    return rows.groupBy(F.col("hospital").alias("state")).agg(F.sum("cases").alias("n"))


@query("P14_name_lookup", """
SELECT product_id, name, code FROM {products} WHERE lower(name) LIKE '%ring%' OR lower(code) LIKE '%ring%'""")
def _(t):
    return catalog.find_by_name(t.products, "RING", "name", "code").select("product_id", "name", "code")


@query("P15_volatile_agents", """
SELECT product_id, max(CASE WHEN lower(trim(unit)) IN ('ml', 'mililitro', 'mililitros') OR regexp_matches(lower(product), 'sevo|desflu|isoflu|halot|anest') OR weighable
       THEN 1 ELSE 0 END) = 1 AS volatile FROM {consumption} GROUP BY 1""")
def _(t):
    return t.consumption.groupBy("product_id").agg(F.max(is_volatile()).alias("volatile"))


@query("P16_line_features", """
SELECT hour(ts) AS hour, isodow(ts) - 1 AS weekday, isodow(ts) >= 6 AS weekend, hour(ts) >= 22 OR hour(ts) < 6 AS night, count(*) AS lines,
       count(CASE WHEN unit = 'mL' AND duration_min > 0 THEN 1 END) AS rated, count(CASE WHEN doctor = '' THEN 1 END) AS no_doctor,
       sum(amount / qty) AS unit_cost FROM {consumption} GROUP BY 1, 2, 3, 4""", "unit_cost:3")
def _(t):
    rows = line_features(t.consumption)
    return rows.groupBy("hour", "weekday", "weekend", "night").agg(
        F.count("*").alias("lines"), F.count("rate").alias("rated"), F.count_if("no_doctor").alias("no_doctor"), F.sum("unit_cost").alias("unit_cost"))


@query("P23_finite_doubles", "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS ratio FROM {lineitem}", "ratio")
def _(t):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_quantity", "l_discount"))
    return clean_doubles(t.lineitem.select("l_orderkey", "l_linenumber", ratio.alias("ratio")))


# ── scalar expressions ───────────────────────────────────────────────────────────────────────────────────────


@query("C01_container_size", r"""
SELECT name, CAST(replace(nullif(regexp_extract(name, '(\d+(?:[.,]\d+)?)\s*(ml|mL|ML|g|gr|kg|L)\b', 1), ''), ',', '.') AS DOUBLE)
       * CASE WHEN lower(regexp_extract(name, '(\d+(?:[.,]\d+)?)\s*(ml|mL|ML|g|gr|kg|L)\b', 2)) IN ('l', 'kg') THEN 1000 ELSE 1 END AS size
FROM (SELECT DISTINCT concat('agent ', p_size, CASE WHEN p_size % 3 = 0 THEN ',5' ELSE '' END,
             CASE p_partkey % 5 WHEN 0 THEN ' mL' WHEN 1 THEN 'L' WHEN 2 THEN ' kg' WHEN 3 THEN ' pieces' ELSE ' g' END) AS name FROM {part})""", "size")
def _(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in (" mL", "L", " kg", " pieces", " g")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("agent "), "p_size", F.when(F.col("p_size") % 3 == 0, ",5").otherwise(""), unit)
    return t.part.select(name.alias("name")).distinct().withColumn("size", text.container_size(F.col("name")))


@query("C02_region", r"""
SELECT DISTINCT location, CASE WHEN location = 'WARD_1' THEN 'MAPPED' WHEN location LIKE '%WARD_3%' THEN 'SOUTH'
       ELSE coalesce(nullif(regexp_extract(token, '^[A-ZÁÉÍÓÚÑ]+'), ''), left(token, 3)) END AS region
FROM (SELECT location, trim(split_part(regexp_replace(upper(location), 'CEDIS[- ]?', '', 'g'), '/', 1)) AS token FROM (
  SELECT to_location AS location FROM {raw_moves} UNION ALL SELECT concat('cedis-', from_location) FROM {raw_moves}))""")
def _(t):
    from stockwarden.operators.rebalance import regions_of

    places = t.raw_moves.select(F.col("to_location").alias("location")).union(
        t.raw_moves.select(F.concat(F.lit("cedis-"), "from_location"))).distinct()
    return regions_of(places, {"WARD_1": "MAPPED", "WARD_3": "SOUTH"})


@query("C03_fingerprints", """
SELECT line_id, left(sha1(concat_ws('|', case_no, product_id, printf('%.3f', qty), strftime(ts, '%Y-%m-%d %H:%M:%S'), lot)), 16) AS line_print,
       left(sha1(concat_ws('|', 'ro', product_id, warehouse)), 14) AS alert_print FROM {consumption}""")
def _(t):
    c = F.col
    return t.consumption.select(
        "line_id", text.line_fingerprint(c("case_no"), c("product_id"), c("qty"), c("ts"), c("lot")).alias("line_print"),
        text.alert_fingerprint(F.lit("ro"), c("product_id"), c("warehouse")).alias("alert_print"))


@query("C04_proposal_key", """
SELECT id, concat_ws('|', kind, product_id, 'origin=' || origin, 'destination=' || destination, 'location=' || location, 'lot=' || lot,
       CASE WHEN kind NOT IN ('transfer', 'purchase', 'reorder_rule') AND origin IS NULL AND destination IS NULL AND location IS NULL AND lot IS NULL
            THEN 't=' || left(sha1(title), 12) END) AS key FROM {proposals}""")
def _(t):
    from stockwarden.operators.ledger import with_key

    return with_key(t.proposals).select("id", "key")


@query("C05_proposal_title", """
SELECT id, CASE kind
  WHEN 'transfer' THEN 'Transfer ' || q || ' of ' || product || ': ' || coalesce(origin, '?') || ' to ' || coalesce(destination, '?')
  WHEN 'purchase' THEN 'Purchase request: ' || q || ' of ' || product
  WHEN 'quarantine' THEN 'Quarantine ' || q || ' of lot ' || coalesce(lot, '?') || ': ' || product || ' at ' || coalesce(origin, '?') END AS title
FROM (SELECT *, CASE WHEN qty = floor(qty) OR unit = 'pc' THEN printf('%,.0f', round_even(qty, 0)) ELSE printf('%,.1f', round_even(qty, 1)) END || ' ' || unit AS q
      FROM {proposals})""")
def _(t):
    c = F.col
    return t.proposals.select("id", text.proposal_title(c("kind"), c("qty"), c("unit"), c("product"), c("origin"), c("destination"), c("lot")).alias("title"))


@query("C06_C07_C08_case_times", "SELECT line_id, ts, duration_min FROM {headed}", "duration_min")
def _(t):
    return consumption.with_headers(consumption.effective_product(t.raw_lines), t.raw_headers).select("line_id", "ts", "duration_min")


@query("C09_period_keys", """
SELECT day, strftime(day, '%Y-%m') AS month, CAST(day + INTERVAL '1' DAY * (7 - isodow(day)) AS DATE) AS week, count(*) AS lines FROM {consumption} GROUP BY 1, 2, 3""")
def _(t):
    return t.consumption.groupBy("day", dates.month_key(F.col("day")).alias("month"), dates.week_ending_sunday(F.col("day")).alias("week")).agg(F.count("*").alias("lines"))


@query("C11_C12_unit_rounding", """
SELECT id, unit, CASE WHEN unit = 'mL' THEN round_even(qty * 10, 0) / 10 ELSE round_even(qty, 0) END AS nearest,
       CASE WHEN unit = 'mL' THEN ceil(qty * 10 - 1e-9) / 10 ELSE ceil(qty - 1e-9) END AS up,
       CASE WHEN unit = 'mL' THEN floor(qty * 10 + 1e-9) / 10 ELSE floor(qty + 1e-9) END AS down FROM {proposals}""", "nearest up down")
def _(t):
    decimals = text.unit_decimals(F.col("unit"))
    return t.proposals.select("id", "unit", *[maths.round_unit(F.col("qty"), decimals, m).alias(m) for m in ("nearest", "up", "down")])


@query("C12_unit_precision", "SELECT name AS unit, CASE WHEN rounding >= 1 THEN 0 ELSE CAST(round(-log10(rounding)) AS INT) END AS decimals FROM {units}")
def _(t):
    return catalog.unit_precision(t.units)


@query("C13_C14_base_units_and_multiples", """
SELECT id, qty / 0.25e0 * 2.0e0 AS base, CASE WHEN qty > 0 THEN ceil(qty / 12 - 1e-9) * 12 ELSE 0 END AS in_boxes FROM {proposals}""", "base in_boxes")
def _(t):
    return t.proposals.select("id", maths.to_base_unit(F.col("qty"), F.lit(0.25), F.lit(2.0)).alias("base"),
                              maths.to_multiple(F.col("qty"), F.lit(12.0)).alias("in_boxes"))


@query("C19_json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM {events}")
def _(t):
    rows = tables.parse_json(t.events.select("event_id", "props"), props="k bigint")
    return rows.select("event_id", "props.k")


@query("C20_capacity_overrides", """
SELECT product_id, product, CASE WHEN product_id = 2 THEN 500.0e0 WHEN product_id = 1 THEN 300.0e0 WHEN product_id < 4 THEN 250.0e0 END AS capacity
FROM (SELECT product_id, min(product) AS product FROM {consumption} GROUP BY 1)""", "capacity")
def _(t):
    from stockwarden.operators.features import container_capacity

    master = t.costs.filter("product_id = 1 or product_id = 2").selectExpr("product_id", "300.0D as capacity")
    manual = t.costs.filter("product_id = 2").selectExpr("product_id", "500.0D as capacity")
    return container_capacity(t.consumption, master, manual)


PRICES = [("cl", 1.0, 5.0, 0.1), ("click", 3.0, 15.0, 0.05), ("view", 0.5, 1.0, 0.1), ("err", 2.0, 8.0, 0.1)]

CTES["costed"] = """
SELECT u.*, coalesce(p.price_in, 5.0e0) AS price_in, coalesce(p.price_out, 25.0e0) AS price_out,
       round_even(tokens_in + cache_write * 1.25e0 + cache_read * coalesce(p.read_weight, 0.1e0), 0) AS tokens_equivalent
FROM {usage} u LEFT JOIN (SELECT model, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT model FROM {usage}) m
  JOIN (VALUES ('cl'), ('click'), ('view'), ('err')) v(prefix) ON starts_with(model, prefix) GROUP BY 1) b ON b.model = u.model
LEFT JOIN (VALUES ('cl', 1.0e0, 5.0e0, 0.1e0), ('click', 3.0e0, 15.0e0, 0.05e0), ('view', 0.5e0, 1.0e0, 0.1e0), ('err', 2.0e0, 8.0e0, 0.1e0)) p(prefix, price_in, price_out, read_weight)
  ON p.prefix = b.prefix
"""


def _costed(t):
    prices = t.spark.createDataFrame(PRICES, "prefix string, price_in double, price_out double, read_weight double")
    c = F.col
    priced = price_by_longest_prefix(t.usage, prices, (5.0, 25.0))
    equivalent = F.rint(c("tokens_in") + c("cache_write") * 1.25 + c("cache_read") * c("read_weight"))
    return priced.withColumns({
        "tokens_equivalent": equivalent,
        "cost": maths.usage_cost(c("tokens_in"), c("tokens_out"), c("cache_write"), c("cache_read"), c("price_in"), c("price_out"), c("read_weight")),
    })


@query("C17_J22_usage_cost", """
SELECT event_id, price_in, price_out, tokens_equivalent / 1e6 * price_in + tokens_out / 1e6 * price_out AS cost FROM {costed}""", "price_in price_out cost:9")
def _(t):
    return _costed(t).select("event_id", "price_in", "price_out", "cost")


@query("A27_usage_by_period", """
SELECT *, 100 * tokens_in / 100000000 AS pct_in, 100 * tokens_out / 5000000 AS pct_out, tokens_in >= 100000000 OR tokens_out >= 5000000 AS exhausted,
       greatest(100 * tokens_in / 100000000, 100 * tokens_out / 5000000) >= 80 AS warning
FROM (SELECT strftime(ts, '%Y-%m') AS period, sum(tokens_equivalent) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, count(*) AS calls,
             sum(tokens_equivalent / 1e6 * price_in + tokens_out / 1e6 * price_out) AS cost FROM {costed} GROUP BY 1)""", "tokens_in:1 cost:2 pct_in pct_out")
def _(t):
    return usage_by_period(_costed(t), 100_000_000, 5_000_000)


# ── joins of the read path ───────────────────────────────────────────────────────────────────────────────────


@query("J01_line_header_join", "SELECT line_id, case_no, hospital, technician, ts FROM {headed}")
def _(t):
    rows = consumption.with_headers(consumption.effective_product(t.raw_lines), t.raw_headers)
    return rows.select("line_id", "case_no", "hospital", "technician", "ts")


@query("J02_W18_first_lot_join", """
SELECT d.line_id, coalesce(f.lot, '') AS lot, f.expiry FROM {headed} d LEFT JOIN {first_lot} f ON f.picking_id = d.picking_id AND f.product_id = d.product_id""")
def _(t):
    rows = consumption.with_headers(consumption.effective_product(t.raw_lines), t.raw_headers)
    return consumption.with_lots(rows, t.raw_moves).select("line_id", "lot", "expiry")


@query("J03_value_at_cost", """
SELECT l.line_id, ROUND(l.qty * c.standard_cost, 2) AS amount, c.standard_cost > 0 AS amount_estimated FROM {raw_lines} l LEFT JOIN {costs} c ON c.product_id = l.product_id""", "amount:1")
def _(t):
    return consumption.value_at_cost(t.raw_lines, t.costs).select("line_id", "amount", "amount_estimated")


@query("J03b_value_in_base_unit", """
SELECT m.move_id, CASE WHEN m.unit = c.base_unit THEN ROUND(m.qty * c.standard_cost, 2) ELSE 0 END AS amount, m.unit = c.base_unit AS amount_estimated
FROM {raw_moves} m LEFT JOIN {costs} c ON c.product_id = m.product_id""", "amount:1")
def _(t):
    rows = consumption.value_at_cost(t.raw_moves.withColumn("amount", F.lit(0.0)), t.costs, base_unit_only=True)
    return rows.select("move_id", "amount", "amount_estimated")


@query("J04_U01_pending_union", "SELECT kind, ref, product_id, qty, to_location FROM {pending_raw}", "qty:2")
def _(t):
    factors = catalog.absolute_factors(t.units)
    bought = supply.pending_purchases(t.purchase_lines, t.purchase_orders, t.receipt_types, t.base_units, factors, AS_OF)
    moved = supply.pending_transfers(t.transfer_moves, t.base_units, factors, AS_OF)
    return supply.pending_supply(bought, moved).select("kind", "ref", "product_id", "qty", "to_location")


@query("W02_lead_times", """
SELECT product_id, delay AS days FROM (SELECT coalesce(product_id, template_id) AS product_id, delay,
  row_number() OVER (PARTITION BY coalesce(product_id, template_id) ORDER BY sequence, id) AS rn FROM {suppliers}) WHERE rn = 1""", "days")
def _(t):
    return catalog.lead_times(t.suppliers)


@query("J05_purchase_units", """
SELECT p.product_id, fb.name AS base_unit, fp.name AS purchase_unit, fb.factor / fp.factor AS ratio FROM (
  SELECT p.*, coalesce(a.unit_id, b.unit_id) AS buy FROM {products} p
  LEFT JOIN (SELECT product_id, arg_min(unit_id, (sequence, id)) AS unit_id FROM {suppliers} WHERE unit_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1) a ON a.product_id = p.product_id
  LEFT JOIN (SELECT template_id, arg_min(unit_id, (sequence, id)) AS unit_id FROM {suppliers} WHERE unit_id IS NOT NULL GROUP BY 1) b ON b.template_id = p.template_id
  WHERE p.active) p
LEFT JOIN {unit_factors} fb ON fb.unit_id = p.base_unit_id LEFT JOIN {unit_factors} fp ON fp.unit_id = p.buy
WHERE p.buy IS NOT NULL AND p.buy <> p.base_unit_id""", "ratio:6")
def _(t):
    return catalog.purchase_units(t.products, t.suppliers, catalog.absolute_factors(t.units))


@query("J06_unit_chain", "SELECT name, factor FROM {unit_factors}", "factor:9")
def _(t):
    return catalog.absolute_factors(t.units).select("name", "factor")


# ── billing ──────────────────────────────────────────────────────────────────────────────────────────────────


@query("A06_billing_totals", """
SELECT count(*) FILTER (state = 'posted') AS invoices, count(*) FILTER (state = 'draft') AS drafts, sum(total) FILTER (state = 'posted') AS billed,
       sum(total) FILTER (state = 'posted') - sum(balance) FILTER (state = 'posted') AS collected, sum(balance) FILTER (state = 'posted') AS receivable,
       sum(balance) FILTER (state = 'posted' AND overdue) AS overdue, count(*) FILTER (state = 'posted' AND overdue) AS overdue_invoices FROM {invoices}""",
       "billed:2 collected:2 receivable:2 overdue:2")
def _(t):
    return billing.billing_totals(_invoices(t))


@query("A06_billing_by_month", "SELECT month, sum(total) AS total, sum(balance) AS balance FROM {invoices} WHERE state = 'posted' GROUP BY 1", "total:2 balance:2")
def _(t):
    return billing.billing_by_month(_invoices(t))


@query("A06_O05_top_customers", """
SELECT customer, sum(total) AS total, sum(balance) AS balance FROM {invoices} WHERE state = 'posted' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "total:2 balance:2")
def _(t):
    return billing.top_customers(_invoices(t))
