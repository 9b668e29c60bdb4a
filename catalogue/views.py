"""The engine's input tables derived from the order / lineitem star schema.

Each view is one SQL text that both Spark and DuckDB accept; `{name}` is a source table or an earlier view.
Planted irregularities (duplicates, impossible weights, travelling lots, an over-consuming technician, a level
shift) are part of the views, so every rule has something to find.
"""

from __future__ import annotations

import re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

AS_OF = "2001-08-01"

VIEWS: dict[str, str] = {}

VIEWS["facts"] = """
SELECT l.*, o.o_custkey, o.o_orderstatus, c.c_mktsegment, n.n_nationkey, n.n_name, n.n_regionkey, s.s_name, s.s_nationkey,
       CAST(l.l_partkey % 16 AS BIGINT) AS product_id,
       l.l_quantity
         * CASE WHEN l.l_partkey % 16 = 0 AND o.o_custkey % 4 = 0 THEN 3.0e0 ELSE 1.0e0 END
         * CASE WHEN l.l_partkey % 16 IN (1, 5) AND n.n_nationkey = 3 AND l.l_shipdate >= TIMESTAMP '2001-02-01 00:00:00'
                THEN 2.0e0 ELSE 1.0e0 END AS used_qty
FROM (SELECT *, 0 AS copy FROM {lineitem} UNION ALL SELECT *, 1 AS copy FROM {lineitem} WHERE l_orderkey % 500 = 0) l
JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN {customer} c ON c.c_custkey = o.o_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
"""

VIEWS["consumption"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), copy) AS line_id,
       l_shipdate + INTERVAL '1' HOUR * CAST(l_orderkey % 24 AS INT) AS ts,
       CAST(l_shipdate AS DATE) AS day,
       l_orderkey AS case_id,
       concat('C', l_orderkey) AS case_no,
       n_name AS hospital,
       CASE WHEN l_orderkey % 50 = 0 THEN '' ELSE s_name END AS doctor,
       concat('T', n_regionkey, '-', o_custkey % 4) AS technician,
       concat(n_name, CASE WHEN o_custkey % 2 = 0 THEN '/OR' ELSE '/ICU' END) AS sublocation,
       n_name AS warehouse,
       product_id,
       CASE WHEN product_id < 4 THEN concat('volatile agent ', product_id, ' 250 mL') ELSE concat('supply ', product_id) END AS product,
       concat('L', product_id, '-', CASE WHEN l_orderkey % 1000 = 0 THEN (n_nationkey + 1) % 25 ELSE n_nationkey END) AS lot,
       CASE WHEN l_orderkey % 300 = 0 THEN l_shipdate - INTERVAL '10' DAY ELSE l_shipdate + INTERVAL '200' DAY END AS expiry,
       used_qty * CASE WHEN l_orderkey % 701 = 0 THEN 10.0e0 ELSE 1.0e0 END AS qty,
       CASE WHEN product_id < 4 THEN 'mL' ELSE 'pc' END AS unit,
       l_extendedprice AS amount,
       FALSE AS amount_estimated,
       CASE WHEN product_id < 4 AND l_linenumber <> 7 THEN CAST(150 + l_orderkey % 200 AS DOUBLE) END AS weight_start,
       CASE WHEN product_id < 4 AND l_linenumber <> 7 THEN
            CAST(150 + l_orderkey % 200 AS DOUBLE)
            - used_qty * 1.5e0 * CASE WHEN l_orderkey % 40 = 0 THEN 1.0e0 + l_discount * 10.0e0 ELSE 1.0e0 END
            + CASE WHEN l_orderkey % 97 = 0 THEN 200.0e0 ELSE 0.0e0 END END AS weight_end,
       CASE WHEN product_id = 3 THEN used_qty END AS measured_ml,
       product_id = 3 AS weighable,
       CASE WHEN l_orderkey % 50 <> 0 THEN CAST(40 + (l_orderkey * 7) % 240 AS DOUBLE) END AS duration_min,
       'clinical' AS source
FROM {facts}
"""

VIEWS["history"] = """
SELECT * FROM {consumption} WHERE ts < TIMESTAMP '2001-08-02 00:00:00'
"""

VIEWS["quants"] = """
SELECT CAST(l.l_partkey % 16 AS BIGINT) AS product_id,
       concat('item ', l.l_partkey % 16) AS product,
       concat(n.n_name, CASE WHEN l.l_suppkey % 2 = 0 THEN '/OR' ELSE '/ICU' END) AS location,
       n.n_name AS warehouse,
       concat('L', l.l_partkey % 16, '-', l.l_suppkey % 6) AS lot,
       CAST(TIMESTAMP '2001-06-01 00:00:00' + INTERVAL '1' DAY * CAST((min(l.l_suppkey) * 37 + max(l.l_partkey)) % 500 AS INT) AS TIMESTAMP{ntz}) AS expiry,
       CAST(floor(sum(l.l_quantity) / 80.0e0) AS DOUBLE) AS qty,
       CAST(floor(sum(CASE WHEN l.l_orderkey % 10 = 0 THEN l.l_quantity ELSE 0.0e0 END) / 80.0e0) AS DOUBLE) AS reserved,
       CASE WHEN l.l_partkey % 16 = 15 AND l.l_suppkey % 6 = 5 THEN 'supplier' ELSE 'internal' END AS usage
FROM {lineitem} l
JOIN {supplier} s ON s.s_suppkey = l.l_suppkey
JOIN {nation} n ON n.n_nationkey = s.s_nationkey
GROUP BY l.l_partkey % 16, n.n_name, l.l_suppkey % 2, l.l_suppkey % 6
"""

VIEWS["pending"] = """
SELECT CASE WHEN o_orderstatus = 'O' THEN 'purchase' ELSE 'transfer' END AS kind,
       concat(CASE WHEN o_orderstatus = 'O' THEN 'PO' ELSE 'TR' END, l_orderkey) AS ref,
       CASE WHEN o_orderstatus = 'O' THEN s_name ELSE '' END AS supplier,
       product_id,
       l_quantity AS qty, l_quantity AS qty_doc, CASE WHEN product_id < 4 THEN 'mL' ELSE 'pc' END AS unit_doc,
       concat(n_name, CASE WHEN o_custkey % 2 = 0 THEN '/OR' ELSE '/ICU' END) AS to_location,
       CASE WHEN o_orderstatus = 'O' THEN s_name ELSE concat('NATION_', s_nationkey, '/OR') END AS from_location,
       l_shipdate AS due_at,
       l_linenumber <> 6 AS confirmed,
       l_shipdate < TIMESTAMP '2001-08-01 00:00:00' AS late
FROM {facts}
WHERE copy = 0 AND o_orderstatus IN ('O', 'P') AND l_shipdate > TIMESTAMP '2001-07-20 00:00:00'
"""

VIEWS["schedule"] = """
SELECT n_name AS hospital, CAST(l_shipdate AS DATE) AS day, count(DISTINCT l_orderkey) AS cases
FROM {facts}
WHERE copy = 0 AND o_orderstatus = 'F' AND l_shipdate > TIMESTAMP '2001-08-01 00:00:00'
GROUP BY n_name, CAST(l_shipdate AS DATE)
"""

VIEWS["raw_headers"] = """
SELECT o.o_orderkey AS case_id, concat('C', o.o_orderkey) AS case_no,
       CASE WHEN o.o_orderstatus = 'F' THEN 'done' WHEN o.o_orderkey % 10 = 0 THEN 'cancel' ELSE 'draft' END AS state,
       o.o_orderdate - INTERVAL '1' DAY AS registered,
       CASE WHEN o.o_orderkey % 20 <> 0 THEN o.o_orderdate END AS surgery_day,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 0.0e0 ELSE CAST(o.o_orderkey % 48 AS DOUBLE) / 2.0e0 END AS start_hour,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 0.0e0 ELSE CAST((o.o_orderkey + 3) % 48 AS DOUBLE) / 2.0e0 END AS end_hour,
       CASE WHEN o.o_orderkey % 9 = 0 THEN o.o_orderdate + INTERVAL '9' HOUR END AS start_ts,
       CASE WHEN o.o_orderkey % 9 = 0 THEN o.o_orderdate + INTERVAL '10' HOUR + INTERVAL '35' MINUTE END AS end_ts,
       CASE WHEN o.o_orderkey % 50 = 0 THEN '' ELSE concat('D', o.o_custkey % 30) END AS doctor,
       concat('T', n.n_regionkey, '-', o.o_custkey % 4) AS technician,
       n.n_name AS hospital, CAST(n.n_nationkey AS BIGINT) AS hospital_id,
       concat(n.n_name, '/OR') AS sublocation,
       o.o_orderkey AS picking_id
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

VIEWS["raw_lines"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS line_id,
       CASE WHEN l_linenumber = 6 AND l_partkey % 5 = 0 THEN -l_orderkey ELSE l_orderkey END AS case_id, '' AS case_no, CAST(NULL AS TIMESTAMP{ntz}) AS ts,
       CAST(l_partkey % 16 AS BIGINT) AS product_id, concat('item ', l_partkey % 16) AS product,
       CASE WHEN l_linenumber = 2 THEN CAST((l_partkey + 1) % 16 AS BIGINT) END AS effective_product_id,
       CASE WHEN l_linenumber = 2 AND l_partkey % 2 = 0 THEN concat('variant ', (l_partkey + 1) % 16) END AS effective_product,
       CASE WHEN l_linenumber = 5 AND l_partkey % 7 = 0 THEN 0.0e0 ELSE l_quantity END AS qty,
       CASE WHEN l_partkey % 16 < 4 THEN 'mL' ELSE 'pc' END AS unit,
       CAST(0 AS DOUBLE) AS amount,
       CASE WHEN l_linenumber = 3 THEN 'ANNEX' ELSE '' END AS hospital,
       '' AS doctor, '' AS technician, '' AS sublocation,
       CASE WHEN l_linenumber = 4 THEN 33.0e0 END AS duration_min
FROM {lineitem}
"""

VIEWS["raw_moves"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS move_id,
       l_orderkey AS picking_id, CAST(l_partkey % 16 AS BIGINT) AS product_id, concat('item ', l_partkey % 16) AS product,
       CASE WHEN l_linenumber = 1 THEN '' ELSE concat('L', l_partkey % 16, '-', l_suppkey % 6) END AS lot,
       l_shipdate + INTERVAL '200' DAY AS expiry, l_quantity AS qty, l_shipdate AS ts,
       CASE WHEN l_partkey % 16 < 4 THEN 'mL' WHEN l_linenumber = 7 THEN 'box' ELSE 'pc' END AS unit,
       CASE WHEN l_returnflag = 'R' THEN 'draft' ELSE 'done' END AS state,
       CASE WHEN l_linestatus = 'F' THEN 'internal' ELSE 'supplier' END AS from_usage,
       CASE WHEN l_linenumber % 3 = 0 THEN 'internal' ELSE 'customer' END AS to_usage,
       concat('NATION_', l_suppkey % 25, '/OR') AS from_location, concat('WARD_', l_suppkey % 9) AS to_location,
       concat('OUT', l_orderkey) AS reference
FROM {lineitem}
"""

VIEWS["costs"] = """
SELECT CAST(p_partkey % 16 AS BIGINT) AS product_id, min(p_retailprice) AS standard_cost,
       CASE WHEN p_partkey % 16 < 4 THEN 'mL' ELSE 'pc' END AS base_unit
FROM {part} GROUP BY p_partkey % 16
"""

VIEWS["units"] = """
SELECT p_partkey + 1 AS unit_id, concat('unit ', p_partkey + 1) AS name,
       CASE WHEN p_size % 3 = 0 THEN 1.0e0 WHEN p_size % 3 = 1 THEN 0.1e0 ELSE 0.001e0 END AS rounding,
       CASE WHEN p_partkey % 64 = 5 THEN 0.5e0 END AS factor,
       CASE WHEN p_partkey % 128 = 77 THEN p_partkey + 1 WHEN p_partkey >= 1 THEN CAST(floor((p_partkey + 1) / 2) AS BIGINT) END AS parent_id,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(1 + p_size % 4 AS DOUBLE) END AS relative_factor
FROM {part}
"""

VIEWS["suppliers"] = """
SELECT l_orderkey * 100 + l_linenumber AS id, CASE WHEN l_linenumber < 5 THEN l_partkey END AS product_id,
       l_partkey % 97 AS template_id, CAST(l_suppkey % 9 AS INT) AS sequence, CAST(3 + l_suppkey % 20 AS DOUBLE) AS delay,
       CASE WHEN l_linenumber <> 3 THEN 1 + l_partkey % 50 END AS unit_id
FROM {lineitem}
"""

VIEWS["products"] = """
SELECT p_partkey AS product_id, p_partkey % 97 AS template_id, p_name AS name, concat('REF-', p_partkey) AS code, p_partkey AS id,
       p_size % 11 <> 0 AS active,
       CASE WHEN p_size % 7 = 0 THEN 'service' WHEN p_size % 2 = 0 THEN 'product' ELSE 'consu' END AS kind,
       CAST(1 + p_partkey % 40 AS BIGINT) AS base_unit_id
FROM {part}
"""

VIEWS["purchase_lines"] = """
SELECT l_orderkey AS order_id, CAST(l_partkey % 16 AS BIGINT) AS product_id, l_quantity AS ordered,
       CASE WHEN l_linenumber % 3 = 0 THEN l_quantity WHEN l_linenumber % 3 = 1 THEN 2.0e0 ELSE 0.0e0 END AS received,
       CASE WHEN l_returnflag = 'R' THEN 'draft' WHEN l_returnflag = 'A' THEN 'done' ELSE 'purchase' END AS state,
       CASE WHEN l_linenumber <> 4 THEN l_shipdate END AS planned,
       concat('unit ', 1 + l_partkey % 30) AS unit_doc
FROM {lineitem}
"""

VIEWS["purchase_orders"] = """
SELECT o.o_orderkey AS order_id, concat('PO', o.o_orderkey) AS order_ref, c.c_name AS supplier, o.o_custkey % 10 AS receipt_type_id,
       CASE WHEN o.o_orderkey % 15 = 0 THEN 'cancel' ELSE 'purchase' END AS order_state, o.o_orderdate + INTERVAL '7' DAY AS planned
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

VIEWS["receipt_types"] = """
SELECT CAST(n_nationkey AS BIGINT) AS receipt_type_id, concat(n_name, '/STOCK') AS to_location FROM {nation} WHERE n_nationkey < 8
"""

VIEWS["base_units"] = """
SELECT CAST(p_partkey % 16 AS BIGINT) AS product_id, concat('unit ', 1 + min(p_partkey) % 20) AS base_unit FROM {part} GROUP BY p_partkey % 16
"""

VIEWS["transfer_moves"] = """
SELECT concat('TR', l_orderkey) AS ref, CAST(l_partkey % 16 AS BIGINT) AS product_id, l_quantity AS qty_doc,
       CASE WHEN l_linenumber = 1 THEN 0.0e0 WHEN l_linenumber = 2 THEN NULL ELSE l_quantity * 2.0e0 END AS base_qty,
       concat('unit ', 1 + l_partkey % 30) AS unit_doc, concat('WARD_', l_suppkey % 9) AS to_location,
       concat('NATION_', l_suppkey % 25, '/OR') AS from_location, l_shipdate AS due_at,
       CASE l_linenumber WHEN 1 THEN 'draft' WHEN 2 THEN 'waiting' WHEN 3 THEN 'assigned' WHEN 4 THEN 'done' WHEN 5 THEN 'confirmed'
            ELSE 'partially_available' END AS state,
       CASE WHEN l_linestatus = 'F' THEN 'internal' ELSE 'supplier' END AS from_usage,
       CASE WHEN l_returnflag = 'A' THEN 'customer' ELSE 'internal' END AS to_usage
FROM {lineitem}
"""

VIEWS["account_moves"] = """
SELECT concat('INV', o.o_orderkey) AS number, c.c_name AS customer, CAST(o.o_orderdate AS DATE) AS date,
       CAST(o.o_orderdate + INTERVAL '30' DAY AS DATE) AS due, o.o_totalprice AS total,
       o.o_totalprice * 0.5e0 AS subtotal,
       CASE WHEN o.o_orderstatus = 'O' THEN o.o_totalprice ELSE 0.0e0 END AS balance,
       CASE WHEN o.o_orderkey % 41 = 0 THEN 'draft' WHEN o.o_orderkey % 43 = 0 THEN 'cancel' ELSE 'posted' END AS state,
       CASE WHEN o.o_orderstatus = 'O' THEN 'not_paid' ELSE 'paid' END AS payment_state,
       CASE WHEN o.o_orderkey % 37 = 0 THEN 'out_refund' WHEN o.o_orderkey % 31 = 0 THEN 'in_invoice' ELSE 'out_invoice' END AS kind,
       o.o_orderkey AS order_id
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

VIEWS["account_lines"] = """
SELECT m.number, m.customer, m.kind, m.state, m.date, CASE WHEN l.l_linenumber <> 7 THEN CAST(l.l_partkey % 16 AS BIGINT) END AS product_id,
       l.l_quantity AS qty, l.l_extendedprice / l.l_quantity AS unit_price, l.l_extendedprice AS amount
FROM {lineitem} l JOIN {account_moves} m ON m.order_id = l.l_orderkey
"""

VIEWS["proposals"] = """
SELECT o.o_orderkey AS id,
       CASE o.o_orderkey % 8 WHEN 0 THEN 'transfer' WHEN 1 THEN 'transfer' WHEN 2 THEN 'purchase' WHEN 3 THEN 'purchase' WHEN 4 THEN 'reorder_rule'
            WHEN 5 THEN 'quarantine' WHEN 6 THEN 'alert' ELSE 'unknown_kind' END AS kind,
       CASE o.o_orderkey % 11 WHEN 0 THEN 'proposed' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'approved' WHEN 3 THEN 'executing'
            WHEN 4 THEN 'approved_manual' WHEN 5 THEN 'executed' WHEN 6 THEN 'late' WHEN 7 THEN 'concluded' WHEN 8 THEN 'rejected'
            WHEN 9 THEN 'proposed' ELSE 'expired' END AS status,
       CAST(o.o_custkey % 16 AS BIGINT) AS product_id,
       concat('item ', o.o_custkey % 16) AS product,
       CAST(1 + o.o_orderkey % 400 AS DOUBLE) / 4.0e0 * CASE WHEN o.o_orderkey % 101 = 0 THEN 300.0e0 ELSE 1.0e0 END AS qty,
       CASE WHEN o.o_custkey % 16 < 4 THEN 'mL' ELSE 'pc' END AS unit,
       CASE WHEN o.o_orderkey % 8 IN (0, 1, 5) THEN concat('NATION_', o.o_custkey % 25) END AS origin,
       CASE WHEN o.o_orderkey % 8 IN (0, 1) THEN concat('NATION_', (o.o_custkey + 1 + o.o_orderkey % 3) % 25) END AS destination,
       CASE WHEN o.o_orderkey % 8 = 4 THEN concat('NATION_', o.o_custkey % 25) END AS location,
       CASE WHEN o.o_orderkey % 8 = 5 THEN concat('L', o.o_custkey % 16, '-', o.o_orderkey % 6) END AS lot,
       o.o_totalprice / 4.0e0 AS amount,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'critical' WHEN 2 THEN 'reorder' END AS criticality,
       CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST(TIMESTAMP '2001-08-01 00:00:00' + INTERVAL '1' DAY * CAST(o.o_orderkey % 15 AS INT) AS DATE) END AS needed_on,
       CASE WHEN o.o_orderkey % 4 <> 3 THEN o.o_orderkey % 4 <> 1 END AS in_time,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 12.5e0 ELSE 0.0e0 END AS covered_before,
       o.o_orderkey % 7 = 0 AS origin_short,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'draft' WHEN o.o_orderkey % 3 = 1 THEN 'assigned' END AS doc_state,
       concat(CASE WHEN o.o_orderkey % 8 IN (2, 3) THEN 'PO' ELSE 'TR' END, o.o_orderkey) AS doc_ref,
       CASE WHEN o.o_orderkey % 8 IN (2, 3) THEN 'purchase' ELSE 'transfer' END AS doc_kind,
       TIMESTAMP '2001-08-01 00:00:00' - INTERVAL '1' DAY * CAST(o.o_orderkey % 20 AS INT) AS created_at,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk,
       CAST(o.o_orderkey % 4 AS BIGINT) AS last_run,
       concat('Proposal ', o.o_orderkey % 200) AS title
FROM {orders} o
"""

VIEWS["usage"] = """
SELECT event_id, ts, user_id, event_type AS model, CAST(floor(value * 1000) AS BIGINT) AS tokens_in, CAST(floor(value * 100) AS BIGINT) AS tokens_out,
       CAST(user_id % 7 * 10 AS BIGINT) AS cache_write, CAST(user_id % 11 * 10 AS BIGINT) AS cache_read
FROM {events}
"""


class Tables:
    """Spark DataFrames over one data folder: `t.lineitem`, `t.consumption`, …; each view is built once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCES:
            build = lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name == "facts":
            build = self._facts
        elif name in VIEWS:
            build = lambda: self._view(VIEWS[name])
        else:
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def _view(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text)) - {"ntz"}
        return self.spark.sql(text.replace("{ntz}", "_NTZ"), **{n: getattr(self, n) for n in names})

    def _facts(self) -> DataFrame:
        """The rows of the view `facts`, joined so that lines, the largest table, meet the orders with all that belongs to them at once."""
        copies = self.lineitem.filter("l_orderkey % 500 = 0").withColumn("copy", F.lit(1))
        lines = self.lineitem.withColumn("copy", F.lit(0)).unionAll(copies)
        places = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_nationkey", "n_name", "n_regionkey")
        orders = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus").join(places, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
        makers = self.supplier.select("s_suppkey", "s_name", "s_nationkey")
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(makers, F.col("l_suppkey") == F.col("s_suppkey"))
        wide = F.expr("CASE WHEN l_partkey % 16 = 0 AND o_custkey % 4 = 0 THEN 3.0e0 ELSE 1.0e0 END")
        late = F.expr("CASE WHEN l_partkey % 16 IN (1, 5) AND n_nationkey = 3 AND l_shipdate >= TIMESTAMP '2001-02-01 00:00:00' THEN 2.0e0 ELSE 1.0e0 END")
        return rows.drop("o_orderkey", "s_suppkey").withColumns({"product_id": F.expr("CAST(l_partkey % 16 AS BIGINT)"), "used_qty": F.col("l_quantity") * wide * late})


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A table of this data folder written once per application to the shared folder."""
    from stockwarden.session import materialize

    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the CTEs `body` needs, each after those it needs itself, then `body`."""
    texts = {**VIEWS, **(extra or {})}
    seen: set[str] = set()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in texts and name not in seen:
                seen.add(name)
                visit(texts[name])
                needed.append(name)

    visit(body)
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: "" if m[1] == "ntz" else m[1], text)
    ctes = [f"{name} AS ({plain(texts[name])})" for name in needed]
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT * FROM (" + plain(body) + "\n)") if ctes else plain(body)
