"""Ad-hoc questions, overviews and history."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from catalogue.registry import CTES, query
from catalogue.views import stored
from stockwarden.functions.text import contains_text
from stockwarden.operators import adhoc, history, lattice
from stockwarden.session import shared_dir
from stockwarden.sources.stock import usable_stock

CTES["enriched"] = """
SELECT *, hour(ts) AS hour, isodow(ts) - 1 AS weekday, isodow(ts) >= 6 AS weekend, hour(ts) >= 22 OR hour(ts) < 6 AS night, unit = 'mL' OR weighable AS volatile,
       CASE WHEN duration_min > 0 AND unit = 'mL' THEN qty / duration_min END AS rate, doctor = '' AS no_doctor, CASE WHEN qty > 0 THEN amount / qty ELSE 0 END AS unit_cost,
       strftime(ts, '%Y-%m') AS month, CAST(CAST(ts AS DATE) + INTERVAL '1' DAY * (7 - isodow(ts)) AS DATE) AS week, (SELECT max(ts) FROM {consumption}) AS today
FROM {consumption}
"""


def case_lattice_of(t):
    return stored(t.spark, t.folder, "case-lattice", lambda: lattice.case_lattice(t.consumption))


@query("A02_group_by_hospital_month", "SELECT hospital, strftime(ts, '%Y-%m') AS month, sum(qty) AS qty, sum(amount) AS amount, count(DISTINCT case_no) AS cases, count(*) AS lines FROM {consumption} GROUP BY 1, 2",
       "qty amount:2")
def _(t):
    return lattice.rolled_up(case_lattice_of(t), "hospital_month").select("hospital", "month", "qty", "amount", "cases", "lines").orderBy(F.desc("qty"))


@query("A02_group_by_product_technician_day", "SELECT product, technician, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(qty) AS qty, sum(amount) AS amount, count(DISTINCT case_no) AS cases, count(*) AS lines FROM {consumption} GROUP BY 1, 2, 3",
       "qty amount:2")
def _(t):
    return adhoc.group_lines(t.consumption, ["item", "employee", "day"])


@query("A02_group_by_case", "SELECT case_no, sum(qty) AS qty, sum(amount) AS amount, count(*) AS lines FROM {consumption} GROUP BY 1", "qty amount:2")
def _(t):
    return adhoc.group_lines(t.consumption, ["case_no"])


@query("P13_text_filter", """
SELECT line_id, product, hospital FROM {consumption} WHERE concat_ws(chr(1), lower(product), lower(hospital), lower(doctor), lower(technician), lower(case_no), lower(lot), lower(sublocation), lower(warehouse))
  LIKE '%nation_7%'""")
def _(t):
    return adhoc.search_lines(t.consumption, "Nation_7").select("line_id", "product", "hospital")


@query("S21_query_consumption", """
SELECT lot, sum(qty) AS qty, sum(amount) AS amount, count(DISTINCT case_no) AS cases, count(*) AS lines FROM {consumption} WHERE lower(product) LIKE '%volatile%' GROUP BY 1""",
       "qty amount:2")
def _(t):
    rows = adhoc.group_lines(t.consumption.filter(contains_text("VOLATILE", F.col("product"))), ["lot"])
    return rows.orderBy(F.desc("qty"), "lot")


def _answer(t, rows, text, by, sums=("qty",), fmt="parquet"):
    return adhoc.exported(adhoc.question(rows, text, by, sums), f"{shared_dir(t.spark)}/answer-{uuid.uuid4().hex}", fmt)


@query("S21_export_consumption", "SELECT technician, sum(qty) AS qty, sum(amount) AS amount, count(DISTINCT case_no) AS cases, count(*) AS lines FROM {consumption} WHERE lower(product) LIKE '%volatile%' GROUP BY 1", "qty amount:2")
def _(t):
    return _answer(t, t.consumption, "VOLATILE", ["employee"], ("qty", "amount"), "csv")


@query("S21_export_stock", "SELECT warehouse, sum(qty) AS qty, sum(usable) AS usable, count(*) AS lines FROM {stock} WHERE lower(concat_ws(chr(1), product, location, warehouse, lot)) LIKE '%item 1%' GROUP BY 1", "qty usable")
def _(t):
    return _answer(t, usable_stock(t.quants, datetime(2001, 8, 1)), "Item 1", ["warehouse"], ("qty", "usable"))


@query("S21_export_pending", "SELECT kind, ref, product_id, qty, to_location FROM {pending} WHERE lower(concat_ws(chr(1), supplier, ref)) LIKE '%po1%'", "qty")
def _(t):
    return _answer(t, t.pending, "PO1", None).select("kind", "ref", "product_id", "qty", "to_location")


@query("S21_export_invoices", "SELECT customer, sum(qty) AS qty, sum(amount) AS amount, count(*) AS lines FROM {account_lines} WHERE lower(concat_ws(chr(1), customer, number)) LIKE '%customer#%' GROUP BY 1", "qty amount:2")
def _(t):
    return _answer(t, t.account_lines, "Customer#", ["customer"], ("qty", "amount"))


@query("A05_overview", "SELECT count(*) AS lines, count(DISTINCT case_no) AS cases, count(DISTINCT product_id) AS products, count(DISTINCT hospital) AS hospitals, sum(qty) AS qty, sum(amount) AS amount FROM {consumption}",
       "qty amount:2")
def _(t):
    return lattice.whole_overview(case_lattice_of(t), t.consumption)


@query("A05_O05_top_products", "SELECT product, sum(qty) AS qty FROM {consumption} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "qty")
def _(t):
    return adhoc.top_by_quantity(t.consumption, "product")


@query("A05_O05_top_hospitals", "SELECT hospital, sum(qty) AS qty FROM {consumption} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "qty")
def _(t):
    return adhoc.top_by_quantity(t.consumption, "hospital")


@query("A34_total_row", "SELECT hospital, sum(qty) AS qty, sum(amount) AS amount, CAST(grouping(hospital) AS INT) AS is_total FROM {consumption} GROUP BY GROUPING SETS ((hospital), ())", "qty amount:2")
def _(t):
    return adhoc.with_total_row(t.consumption, "hospital", "qty", "amount")


@query("A08_monthly_series", "SELECT month, sum(amount) AS amount, count(DISTINCT case_no) AS cases, count(*) AS lines, sum(CASE WHEN volatile THEN qty ELSE 0 END) AS volatile_ml FROM {enriched} GROUP BY 1",
       "amount:2 volatile_ml")
def _(t):
    return lattice.monthly_cases(case_lattice_of(t))


CTES["trend_months"] = """
SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY month) AS x, row_number() OVER (PARTITION BY product_id ORDER BY month DESC) AS back
FROM (SELECT product_id, month, sum(qty) AS qty, sum(amount) AS amount, min(product) AS product FROM {enriched} WHERE month < strftime(today, '%Y-%m') GROUP BY 1, 2)
"""


@query("A09_W10_product_trends", """
SELECT product_id, product, months, 100 * slope / mean AS trend_pct, last_3m, prev_3m, 100 * (last_3m / prev_3m - 1) AS change_pct, amount_3m FROM (
  SELECT product_id, min(product) AS product, count(*) AS months, regr_slope(qty, x) AS slope, avg(qty) AS mean, avg(qty) FILTER (back <= 3) AS last_3m,
         CASE WHEN count(*) >= 6 THEN avg(qty) FILTER (back BETWEEN 4 AND 6) END AS prev_3m, sum(amount) FILTER (back <= 3) AS amount_3m
  FROM {trend_months} GROUP BY 1 HAVING count(*) >= 4)""", "trend_pct:5 last_3m prev_3m change_pct amount_3m:2")
def _(t):
    return history.product_trends(t.consumption)


@query("A10_hospital_comparison", """
SELECT *, 100 * (amount / nullif(amount_prev, 0) - 1) AS change_pct, amount / nullif(cases, 0) AS amount_per_case, amount_prev / nullif(cases_prev, 0) AS amount_per_case_prev FROM (
  SELECT hospital, coalesce(sum(amount) FILTER (ts > today - INTERVAL '30' DAY), 0) AS amount,
         coalesce(sum(amount) FILTER (ts <= today - INTERVAL '30' DAY AND ts > today - INTERVAL '60' DAY), 0) AS amount_prev,
         count(DISTINCT case_no) FILTER (ts > today - INTERVAL '30' DAY) AS cases,
         count(DISTINCT case_no) FILTER (ts <= today - INTERVAL '30' DAY AND ts > today - INTERVAL '60' DAY) AS cases_prev FROM {enriched} GROUP BY 1)""",
       "amount:2 amount_prev:2 change_pct amount_per_case:6 amount_per_case_prev:6")
def _(t):
    return lattice.compared_hospitals(case_lattice_of(t))


@query("A11_seasonality", """
SELECT kind, slot, qty / avg(qty) OVER (PARTITION BY kind) AS index FROM (
  SELECT 'weekday' AS kind, CAST(weekday AS INT) AS slot, sum(qty) AS qty FROM {enriched} WHERE volatile GROUP BY 2
  UNION ALL SELECT 'month', CAST(month(ts) AS INT), sum(qty) FROM {enriched} WHERE volatile GROUP BY 2)""", "index")
def _(t):
    return history.seasonality(t.consumption)


@query("J16_year_over_year", """
WITH m AS (SELECT month, sum(amount) AS amount FROM {enriched} GROUP BY 1)
SELECT a.month, a.amount, b.amount AS amount_prev, 100 * (a.amount / b.amount - 1) AS change_pct FROM (SELECT * FROM m ORDER BY month DESC LIMIT 6) a
JOIN m b ON b.month = CAST(CAST(left(a.month, 4) AS INT) - 1 AS VARCHAR) || right(a.month, 3) WHERE (SELECT count(*) FROM m) >= 13""", "amount:2 amount_prev:2 change_pct")
def _(t):
    return history.year_over_year(t.consumption)


CTES["cusum_weeks"] = """
SELECT *, row_number() OVER (PARTITION BY hospital ORDER BY week) AS i, count(*) OVER (PARTITION BY hospital) AS n
FROM (SELECT hospital, week, sum(qty) AS x FROM {enriched} WHERE volatile GROUP BY 1, 2 HAVING sum(qty) > 0)
"""
CTES["cusum_base"] = """
SELECT hospital, avg(x) AS mu, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM {cusum_weeks} WHERE n >= 12 AND i <= greatest(6, n // 2) GROUP BY 1
"""
CTES["cusum_walk"] = """
SELECT w.hospital, w.week, w.x, w.i, greatest(0.0e0, (w.x - b.mu) / b.sd - 0.5e0) AS s FROM {cusum_weeks} w JOIN {cusum_base} b USING (hospital) WHERE w.i = 1
UNION ALL
SELECT w.hospital, w.week, w.x, w.i, greatest(0.0e0, p.s + (w.x - b.mu) / b.sd - 0.5e0) FROM cusum_walk p JOIN {cusum_weeks} w ON w.hospital = p.hospital AND w.i = p.i + 1
JOIN {cusum_base} b ON b.hospital = w.hospital
"""


@query("W11_structural_changes", """
SELECT k.hospital, k.week, k.s AS cusum, b.mu AS level_before, (SELECT avg(x) FROM {cusum_walk} y WHERE y.hospital = k.hospital AND y.i >= k.i) AS level_after
FROM (SELECT *, row_number() OVER (PARTITION BY hospital ORDER BY round(s, 9) DESC, i) AS rn FROM {cusum_walk}) k JOIN {cusum_base} b USING (hospital) WHERE k.rn = 1 AND k.s > 5""",
       "cusum level_before level_after")
def _(t):
    return history.structural_changes(t.consumption)


@query("A22_monthly_by_unit", "SELECT month, unit, sum(qty) AS qty, sum(amount) AS amount FROM {enriched} GROUP BY 1, 2", "qty amount:2")
def _(t):
    return history.demand_history(t.consumption)["monthly_by_unit"]


@query("A22_last_26_weeks", "SELECT week, sum(amount) AS amount FROM {enriched} GROUP BY 1 ORDER BY 1 DESC LIMIT 26", "amount:2")
def _(t):
    return history.demand_history(t.consumption)["last_26_weeks"]


@query("A22_growth_90_days", """
SELECT *, 100 * (last / nullif(previous, 0) - 1) AS change_pct FROM (
  SELECT product_id, product, unit, sum(qty) FILTER (ts > today - INTERVAL '90' DAY) AS last,
         coalesce(sum(qty) FILTER (ts <= today - INTERVAL '90' DAY AND ts > today - INTERVAL '180' DAY), 0) AS previous FROM {enriched} GROUP BY 1, 2, 3) WHERE last IS NOT NULL""",
       "last previous change_pct")
def _(t):
    return history.growth(t.consumption, history.last_moment(t.consumption))


@query("A30_product_weeks", """
WITH used AS (SELECT week, sum(qty) AS qty FROM {enriched} WHERE lower(product) LIKE '%agent 2%' AND (lower(sublocation) LIKE '%nation_4%' OR lower(warehouse) LIKE '%nation_4%') GROUP BY 1),
dense AS (SELECT CAST(w AS DATE) AS week FROM (SELECT unnest(generate_series(greatest(min(week), max(week) - INTERVAL '77' DAY), max(week), INTERVAL '7' DAY)) AS w FROM used)),
s AS (SELECT d.week, coalesce(u.qty, 0) AS qty, row_number() OVER (ORDER BY d.week) AS i, count(*) OVER () AS n FROM dense d LEFT JOIN used u USING (week))
SELECT week, qty, avg(qty) OVER () AS mean, CASE WHEN n > 4 AND avg(qty) FILTER (i > n - 4) OVER () > avg(qty) FILTER (i <= 4) OVER () * 1.15 THEN 'up'
  WHEN n > 4 AND avg(qty) FILTER (i > n - 4) OVER () < avg(qty) FILTER (i <= 4) OVER () * 0.85 THEN 'down' ELSE 'stable' END AS trend FROM s""", "qty mean")
def _(t):
    return history.product_weeks(t.consumption, "agent 2", "nation_4")


CTES["typical"] = "SELECT hospital, quantile_cont(cases, 0.5) AS typical FROM (SELECT hospital, day, count(DISTINCT case_no) AS cases FROM {history} GROUP BY 1, 2) GROUP BY 1"


@query("A31_scheduled_load", """
SELECT s.*, coalesce(y.typical, 0) AS typical, s.per_day / y.typical AS ratio FROM (
  SELECT hospital, CAST(sum(cases) AS BIGINT) AS cases, count(DISTINCT day) AS days, min(day) AS first_day, sum(cases) / count(DISTINCT day) AS per_day FROM {schedule} GROUP BY 1) s
LEFT JOIN {typical} y USING (hospital)""", "per_day typical ratio")
def _(t):
    return history.scheduled_load(t.schedule, history.typical_cases(t.history))


@query("R_HIST_history_pack", """
SELECT 'monthly' AS part, count(DISTINCT month) AS rows, sum(amount) AS amount FROM {enriched} UNION ALL SELECT 'hospitals', count(DISTINCT hospital), sum(amount) FILTER (ts > today - INTERVAL '30' DAY) FROM {enriched}
UNION ALL SELECT 'trends', count(*), sum(amount_3m) FROM (SELECT sum(amount) FILTER (back <= 3) AS amount_3m FROM {trend_months} GROUP BY product_id HAVING count(*) >= 4)""", "amount:2")
def _(t):
    parts = {"monthly": history.monthly(t.consumption), "hospitals": history.hospital_comparison(t.consumption),
             "trends": history.product_trends(t.consumption).withColumnRenamed("amount_3m", "amount")}
    rows = [df.agg(F.count("*").alias("rows"), F.sum("amount").alias("amount")).select(F.lit(name).alias("part"), "rows", "amount") for name, df in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("W15_anchor_moment", "SELECT max(ts) AS today, CAST(max(ts) AS DATE) AS day FROM {consumption}")
def _(t):
    moment = history.last_moment(t.consumption)
    return t.consumption.agg(F.max("ts").alias("today")).select("today", moment.cast("date").alias("day"))
