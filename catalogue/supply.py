"""The supply engine: series, methods, balance, replenishment, classes, expiries and transfers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from catalogue.registry import CTES, query
from catalogue.views import stored
from stockwarden.config import SupplyConfig
from stockwarden.operators import balance, classes, methods, rebalance, replenish, series
from stockwarden.plans import supply_run
from stockwarden.sources import catalog
from stockwarden.sources.stock import stock_by, usable_stock

AS_OF = datetime(2001, 8, 1)
CENTRES = tuple(f"NATION_{i}" for i in range(0, 25, 5))
CFG = SupplyConfig(as_of=date(2001, 8, 1), dimension="warehouse", dc_locations=CENTRES, regions={"NATION_1": "WEST", "NATION_2": "EAST"})
KEYS = series.KEYS


def past_lines(t):
    """Consumption up to the planning day, stored once."""
    return stored(t.spark, t.folder, "history", lambda: t.history)


def lines_at(t, place: str):
    return series.located(past_lines(t).withColumn("place", F.expr(place)), "place")


TEAM = "split(technician, '-')[0]"
NETWORK = "'ALL'"


def wh_lines(t):
    return series.located(past_lines(t), "warehouse")


def wh_series(t):
    return stored(t.spark, t.folder, "wh-series", lambda: supply_run.build_series(wh_lines(t), CFG))


def wh_chosen(t):
    return stored(t.spark, t.folder, "wh-chosen", lambda: supply_run.forecast_keys(wh_series(t), CFG).withColumn("series_end", F.lit(date(2001, 8, 1))))


def all_series(t):
    return stored(t.spark, t.folder, "all-series", lambda: supply_run.build_series(lines_at(t, NETWORK), CFG))


def places(t):
    return balance.main_hospitals(wh_lines(t))


END = "timestamp_ntz '2001-08-01 00:00:00'"


def wh_agenda(t):
    return balance.agenda(t.schedule, balance.case_usage(wh_lines(t), F.expr(END)), places(t), CFG)


def wh_forecasts(t):
    return stored(t.spark, t.folder, "wh-forecasts", lambda: balance.with_agenda(methods.daily_forecasts(wh_chosen(t), CFG), wh_agenda(t)))


def wh_pending(t):
    return t.pending.withColumns({"to_location": F.split("to_location", "/")[0],
                                  "from_location": F.when(F.col("kind") == "transfer", F.split("from_location", "/")[0]).otherwise(F.col("from_location"))})


def wh_events(t):
    return stored(t.spark, t.folder, "wh-events", lambda: balance.supply_events(wh_pending(t), CFG))


def wh_stock(t):
    return supply_run.stock_at(usable_stock(t.quants, AS_OF), "warehouse")


def wh_terms(t):
    def build():
        factors = catalog.absolute_factors(t.units)
        units = catalog.purchase_units(t.products, t.suppliers, factors)
        multiples = t.costs.filter("product_id = 2 or product_id = 9").selectExpr("product_id", "12.0D as multiple")
        return replenish.product_terms(wh_lines(t).select("product_id").distinct(), catalog.lead_times(t.suppliers), units, multiples)

    return stored(t.spark, t.folder, "wh-terms", build)


def wh_costs(t):
    return stored(t.spark, t.folder, "wh-costs", lambda: replenish.unit_costs(wh_lines(t)))


def wh_parameters(t):
    return stored(t.spark, t.folder, "wh-parameters", lambda: replenish.local_parameters(wh_chosen(t), wh_terms(t), wh_stock(t), CFG))


def wh_used(t):
    return stored(t.spark, t.folder, "wh-used", lambda: replenish.local_rows(wh_parameters(t), wh_forecasts(t), wh_events(t), places(t), wh_costs(t), CFG))


def wh_local(t):
    def build():
        names = wh_lines(t).groupBy("product_id").agg(F.min("product").alias("product"), F.min("unit").alias("unit"))
        idle = replenish.stock_only_rows(wh_used(t), wh_stock(t), wh_events(t), wh_terms(t), names, places(t), wh_costs(t), CFG)
        return wh_used(t).unionByName(idle, allowMissingColumns=True)

    return stored(t.spark, t.folder, "wh-local", build)


def wh_plan(t):
    def build():
        net = replenish.network_rows(wh_local(t), wh_forecasts(t), wh_events(t), wh_stock(t), wh_terms(t), wh_costs(t), CFG)
        return wh_local(t).unionByName(net, allowMissingColumns=True)

    return stored(t.spark, t.folder, "wh-plan", build)


# ── series ───────────────────────────────────────────────────────────────────────────────────────────────────

CTES["cal"] = "SELECT CAST(d AS DATE) AS day, row_number() OVER (ORDER BY d) AS i FROM (SELECT unnest(generate_series(TIMESTAMP '2001-08-01' - INTERVAL '539' DAY, TIMESTAMP '2001-08-01', INTERVAL '1' DAY)) AS d)"
CTES["team_lines"] = "SELECT *, split_part(technician, '-', 1) AS location FROM {history}"
CTES["team_gap_days"] = """
WITH own AS (SELECT DISTINCT location, CAST(ts AS DATE) AS day FROM {team_lines}), span AS (SELECT location, min(day) AS a, max(day) AS b FROM own GROUP BY 1),
net AS (SELECT DISTINCT day FROM own WHERE isodow(day) <= 5), cand AS (SELECT s.location, n.day, o.day IS NULL AS gap FROM span s JOIN net n ON n.day BETWEEN s.a AND s.b LEFT JOIN own o ON o.location = s.location AND o.day = n.day)
SELECT location, day FROM cand WHERE gap AND location IN (SELECT location FROM cand GROUP BY 1 HAVING count(*) FILTER (gap) > 0 AND count(*) FILTER (gap) / count(*) <= 0.10)
"""


@query("A16_capture_gaps", "SELECT location, day FROM {team_gap_days}")
def _(t):
    return series.capture_gaps(lines_at(t, TEAM), 0.10).select("location", F.explode("gaps").alias("day"))


CTES["team_daily"] = """
SELECT k.product_id, k.location, c.day, c.i, coalesce(d.qty, 0) AS raw, g.day IS NOT NULL AS gap FROM (SELECT DISTINCT product_id, location FROM {team_lines}) k CROSS JOIN {cal} c
LEFT JOIN (SELECT product_id, location, CAST(ts AS DATE) AS day, sum(qty) AS qty FROM {team_lines} GROUP BY 1, 2, 3) d ON d.product_id = k.product_id AND d.location = k.location AND d.day = c.day
LEFT JOIN {team_gap_days} g ON g.location = k.location AND g.day = c.day
"""


@query("F01_daily_series", """
SELECT d.product_id, d.location, d.day, CASE WHEN d.gap THEN coalesce(m.med, 0) ELSE d.raw END AS qty FROM {team_daily} d
LEFT JOIN (SELECT product_id, location, isodow(day) AS w, quantile_cont(raw, 0.5) AS med FROM {team_daily} WHERE NOT gap GROUP BY 1, 2, 3) m
  ON m.product_id = d.product_id AND m.location = d.location AND m.w = isodow(d.day)""", "qty")
def _(t):
    lines = lines_at(t, TEAM)
    rows = series.daily_series(lines, CFG, series.capture_gaps(lines, CFG.gap_threshold))
    return rows.select(*KEYS, "start", F.posexplode("y").alias("i", "qty")).select(*KEYS, F.date_add("start", F.col("i")).alias("day"), "qty")


@query("F02_dimension_choice", """
SELECT CASE WHEN count(*) FILTER (sublocation <> '') / count(*) > 0.5 THEN 'sublocation' WHEN count(*) FILTER (warehouse <> '') / count(*) > 0.5 THEN 'warehouse' ELSE 'hospital' END AS dimension,
       count(*) AS lines FROM {history}""")
def _(t):
    return t.history.agg(F.count("*").alias("lines")).withColumn("dimension", F.lit(series.choose_dimension(t.history, "sublocation")))


def _series_ctes(prefix: str, location: str) -> None:
    CTES[f"{prefix}_daily"] = f"SELECT product_id, {location} AS location, CAST(ts AS DATE) AS day, sum(qty) AS qty, count(*) AS lines, min(product) AS product, min(unit) AS unit FROM {{history}} GROUP BY 1, 2, 3"
    CTES[f"{prefix}_keys"] = f"SELECT product_id, location, CAST(sum(lines) AS BIGINT) AS lines, min(product) AS product, min(unit) AS unit, max(day) AS last_used FROM {{{prefix}_daily}} GROUP BY 1, 2"
    CTES[f"{prefix}_full"] = f"SELECT k.product_id, k.location, c.day, c.i, coalesce(d.qty, 0) AS qty FROM {{{prefix}_keys}} k CROSS JOIN {{cal}} c LEFT JOIN {{{prefix}_daily}} d ON d.product_id = k.product_id AND d.location = k.location AND d.day = c.day"
    CTES[f"{prefix}_y"] = f"""
SELECT f.product_id, f.location, f.day, f.qty AS y, f.i - o.skip AS t, 540 - o.skip AS n FROM {{{prefix}_full}} f JOIN (
  SELECT product_id, location, CASE WHEN 540 - (first - 1) >= 28 THEN first - 1 ELSE 0 END AS skip FROM (SELECT product_id, location, coalesce(min(i) FILTER (qty > 0), 1) AS first FROM {{{prefix}_full}} GROUP BY 1, 2)) o
  USING (product_id, location) WHERE f.i > o.skip"""
    CTES[f"{prefix}_flags"] = f"""
SELECT *, n < 28 OR demand_days < 5 OR total <= 0 AS insufficient, zero_share > 0.6 AS intermittent FROM (
  SELECT product_id, location, CAST(max(n) AS INT) AS n, CAST(count(*) FILTER (y > 0) AS INT) AS demand_days, count(*) FILTER (y = 0) / count(*) AS zero_share, sum(y) AS total,
         sum(y) FILTER (t > n - 28) AS last_28d, CASE WHEN max(n) >= 56 THEN sum(y) FILTER (t > n - 56 AND t <= n - 28) END AS prev_28d, avg(y) AS mean,
         stddev_pop(y) AS sd, stddev_pop(y) FILTER (t > n - 56) AS tail_sd FROM {{{prefix}_y}} GROUP BY 1, 2)"""
    # states of exponential smoothing (five alphas) and Croston after every day
    step = ", ".join(f"w.e{k} + (s.y - w.l{k}) * (s.y - w.l{k}), {a}e0 * s.y + (1 - {a}e0) * w.l{k}" for k, a in enumerate(methods.SES_ALPHAS, 1))
    CTES[f"{prefix}_walk"] = f"""
SELECT product_id, location, t, {', '.join(f'0.0e0 AS e{k}, y AS l{k}' for k in range(1, 6))}, CASE WHEN y > 0 THEN y END AS z, CASE WHEN y > 0 THEN 1.0e0 END AS p, 1.0e0 AS q FROM {{{prefix}_y}} WHERE t = 1
UNION ALL
SELECT s.product_id, s.location, s.t, {step},
       CASE WHEN w.z IS NULL THEN CASE WHEN s.y > 0 THEN s.y END WHEN s.y > 0 THEN 0.15e0 * s.y + 0.85e0 * w.z ELSE w.z END,
       CASE WHEN w.z IS NULL THEN CASE WHEN s.y > 0 THEN CAST(s.t AS DOUBLE) END WHEN s.y > 0 THEN 0.15e0 * w.q + 0.85e0 * w.p ELSE w.p END,
       CASE WHEN w.z IS NULL OR s.y > 0 THEN 1.0e0 ELSE w.q + 1 END
FROM {prefix}_walk w JOIN {{{prefix}_y}} s ON s.product_id = w.product_id AND s.location = w.location AND s.t = w.t + 1"""
    CTES[f"{prefix}_point"] = f"""
SELECT w.product_id, w.location, w.t, y.n, y.y, greatest(0.0e0, avg(y.y) OVER (PARTITION BY w.product_id, w.location ORDER BY w.t ROWS 27 PRECEDING)) AS moving_average_28,
       greatest(0.0e0, CASE WHEN e1 <= least(e2, e3, e4, e5) THEN l1 WHEN e2 <= least(e3, e4, e5) THEN l2 WHEN e3 <= least(e4, e5) THEN l3 WHEN e4 <= e5 THEN l4 ELSE l5 END) AS exponential_smoothing,
       coalesce(greatest(0.0e0, 0.925e0 * z / p), 0) AS croston_sba
FROM {{{prefix}_walk}} w JOIN {{{prefix}_y}} y USING (product_id, location, t)"""


_series_ctes("wh", "warehouse")
_series_ctes("net", "'ALL'")


@query("F03_series_flags", "SELECT product_id, location, n, zero_share, insufficient, intermittent, last_28d, prev_28d FROM {wh_flags}", "zero_share last_28d prev_28d")
def _(t):
    return wh_series(t).select(*KEYS, "n", "zero_share", "insufficient", "intermittent", "last_28d", "prev_28d")


@query("W17_trailing_means", """
SELECT product_id, location, day, avg(qty) OVER (PARTITION BY product_id, location ORDER BY day ROWS 27 PRECEDING) AS mean_28,
       (lag(qty, 7) OVER (PARTITION BY product_id, location ORDER BY day) + lag(qty, 14) OVER (PARTITION BY product_id, location ORDER BY day)) / 2 AS weekday_naive FROM {wh_full}""", "mean_28 weekday_naive")
def _(t):
    rows = series.daily_series(wh_lines(t), CFG).select(*KEYS, "start", F.posexplode("y").alias("i", "qty"))
    daily = rows.select(*KEYS, F.date_add("start", F.col("i")).alias("day"), "qty")
    return methods.trailing_mean(daily, KEYS).drop("qty")


def _one_method(name: str, source=None):
    def build(t):
        rows = (source or all_series)(t)
        f = methods.METHODS[name](F.col("y"), F.lit(14))
        return rows.select(*KEYS, F.posexplode(f).alias("step", "forecast"))

    return build


_FLAT = "SELECT product_id, location, CAST(s.step AS INT) AS step, {method} AS forecast FROM {{{prefix}_point}} CROSS JOIN (SELECT unnest(range(0, 14)) AS step) s WHERE t = n"
query("F04_moving_average", _FLAT.format(method="moving_average_28", prefix="net"), "forecast")(_one_method("moving_average_28"))
query("F05_exponential_smoothing", _FLAT.format(method="exponential_smoothing", prefix="net"), "forecast")(_one_method("exponential_smoothing"))
query("F10_croston_sba", _FLAT.format(method="croston_sba", prefix="wh"), "forecast")(_one_method("croston_sba", wh_series))
query("F09_seasonal_naive", """
SELECT a.product_id, a.location, CAST(s.step AS INT) AS step, greatest(0.0e0, (a.y + b.y) / 2) AS forecast FROM (SELECT unnest(range(0, 14)) AS step) s JOIN {net_y} a ON a.t = a.n - 6 + s.step % 7
JOIN {net_y} b ON b.product_id = a.product_id AND b.location = a.location AND b.t = a.t - 7""", "forecast")(_one_method("seasonal_naive"))


def _holt_ctes(prefix: str, values: str) -> None:
    CTES[f"{prefix}_holt_start"] = f"""
SELECT s.product_id, s.location, a.a, b.b, a.i * 3 + b.i AS combo, s.y AS l, (r.y - s.y) / least(7, s.n - 1) AS tr FROM {{{values}}} s JOIN {{{values}}} r ON r.product_id = s.product_id AND r.location = s.location AND r.t = 1 + least(7, s.n - 1)
CROSS JOIN (VALUES (0, 0.1e0), (1, 0.2e0), (2, 0.4e0)) a(i, a) CROSS JOIN (VALUES (0, 0.01e0), (1, 0.05e0), (2, 0.1e0)) b(i, b) WHERE s.t = 1"""
    CTES[f"{prefix}_holt_walk"] = f"""
SELECT product_id, location, a, b, combo, CAST(1 AS BIGINT) AS t, l, tr, 0.0e0 AS e FROM {{{prefix}_holt_start}}
UNION ALL
SELECT product_id, location, a, b, combo, t, nl, b * (nl - l) + (1 - b) * 0.9e0 * tr, e + (y - (l + 0.9e0 * tr)) * (y - (l + 0.9e0 * tr)) FROM (
  SELECT w.product_id, w.location, w.a, w.b, w.combo, s.t, s.y, w.l, w.tr, w.e, w.a * s.y + (1 - w.a) * (w.l + 0.9e0 * w.tr) AS nl
  FROM {prefix}_holt_walk w JOIN {{{values}}} s ON s.product_id = w.product_id AND s.location = w.location AND s.t = w.t + 1)"""
    CTES[f"{prefix}_holt"] = f"""
SELECT h.product_id, h.location, s.step, greatest(0.0e0, h.l + 0.9e0 * (1 - power(0.9e0, s.step + 1)) / (1 - 0.9e0) * h.tr) AS v FROM (
  SELECT w.*, row_number() OVER (PARTITION BY w.product_id, w.location ORDER BY e, combo) AS rn FROM {{{prefix}_holt_walk}} w JOIN (SELECT product_id, location, max(t) AS t FROM {{{values}}} GROUP BY 1, 2) m USING (product_id, location, t)) h
CROSS JOIN (SELECT unnest(range(0, 14)) AS step) s WHERE h.rn = 1"""


_holt_ctes("net", "net_y")
CTES["net_index"] = """
SELECT product_id, location, d, least(greatest(m / avg(m) OVER (PARTITION BY product_id, location), 0.2e0), 3.0e0) AS idx FROM (SELECT product_id, location, (t - 1) % 7 AS d, avg(y) AS m FROM {net_y} GROUP BY 1, 2, 3)"""
CTES["net_flat"] = "SELECT y.product_id, y.location, y.t, y.n, y.y / x.idx AS y FROM {net_y} y JOIN {net_index} x ON x.product_id = y.product_id AND x.location = y.location AND x.d = (y.t - 1) % 7"
_holt_ctes("flat", "net_flat")
query("F06_damped_holt", "SELECT product_id, location, CAST(step AS INT) AS step, v AS forecast FROM {net_holt}", "forecast:5")(_one_method("damped_holt"))
query("F08_weekly_holt_winters", """
SELECT h.product_id, h.location, CAST(h.step AS INT) AS step, greatest(0.0e0, h.v * x.idx) AS forecast FROM {flat_holt} h JOIN (SELECT product_id, location, max(n) AS n FROM {net_y} GROUP BY 1, 2) k USING (product_id, location)
JOIN {net_index} x ON x.product_id = h.product_id AND x.location = h.location AND x.d = (k.n + h.step) % 7""", "forecast:5")(_one_method("weekly_holt_winters"))


@query("F07_weekday_index", "SELECT product_id, location, CAST(d AS INT) AS position, idx AS index FROM {net_index}", "index")
def _(t):
    return all_series(t).select(*KEYS, F.posexplode(methods.weekday_index(F.col("y"))).alias("position", "index"))


CTES["wh_trial"] = """
SELECT c.*, s.t AS at, s.y, (s.t - c.cut - 1) // 7 AS block FROM (
  SELECT p.product_id, p.location, p.t AS cut, m.method, m.ord, CASE m.method WHEN 'croston_sba' THEN p.croston_sba WHEN 'moving_average_28' THEN p.moving_average_28 ELSE p.exponential_smoothing END AS pred
  FROM {wh_point} p JOIN {wh_flags} f USING (product_id, location) CROSS JOIN (VALUES (0, 'croston_sba'), (1, 'moving_average_28'), (2, 'exponential_smoothing')) m(ord, method)
  WHERE NOT f.insufficient AND p.t >= 14 AND (f.n - p.t) % 14 = 0 AND p.t < f.n AND (f.n - p.t) // 14 <= CASE WHEN f.n < 63 THEN greatest(1, (f.n - 14) // 14) ELSE 3 END) c
JOIN {wh_y} s ON s.product_id = c.product_id AND s.location = c.location AND s.t > c.cut AND s.t <= c.cut + 14
"""
CTES["wh_fold"] = """
SELECT product_id, location, method, ord, cut, CASE WHEN sum(real) > 0 THEN sum(abs(real - bp)) / sum(real) WHEN sum(bp) = 0 THEN 0 ELSE 1 END AS wape FROM (
  SELECT product_id, location, method, ord, cut, block, sum(y) AS real, sum(pred) AS bp FROM {wh_trial} GROUP BY 1, 2, 3, 4, 5, 6) GROUP BY 1, 2, 3, 4, 5
"""
CTES["wh_best"] = """
SELECT b.product_id, b.location, b.method, b.wape, r.residual_sd, r.bias FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id, location ORDER BY round(wape, 12), ord) AS rn FROM (SELECT product_id, location, method, ord, avg(wape) AS wape FROM {wh_fold} GROUP BY 1, 2, 3, 4)) b
JOIN (SELECT product_id, location, method, stddev_pop(y - pred) AS residual_sd, CASE WHEN sum(y) >= 1 THEN sum(y - pred) / sum(y) ELSE 0 END AS bias FROM {wh_trial} GROUP BY 1, 2, 3) r USING (product_id, location, method)
WHERE b.rn = 1
"""


@query("F11_wape_per_fold", "SELECT product_id, location, method, CAST(cut AS INT) AS cut, wape FROM {wh_fold}", "wape")
def _(t):
    return methods.trials(wh_series(t), CFG).select(*KEYS, "method", "cut", "wape")


@query("F12_backtest_choice", "SELECT * FROM {wh_best}", "wape:8 residual_sd:8 bias:8")
def _(t):
    return methods.choose_method(methods.trials(wh_series(t), CFG)).drop("n_residuals")


@query("F12_backtest_regular_series")
def _(t):
    return methods.choose_method(methods.trials(all_series(t), CFG))


@query("W12_F13_quick_tier", """
SELECT f.product_id, f.location, CASE WHEN r.rn <= 20 THEN 'full' ELSE 'quick' END AS tier FROM {wh_flags} f JOIN (SELECT product_id, location, row_number() OVER (ORDER BY lines DESC, product_id, location) AS rn FROM {wh_keys}) r USING (product_id, location)""")
def _(t):
    few = SupplyConfig(as_of=date(2001, 8, 1), max_backtests=20)
    return methods.rank_keys(wh_series(t).drop("full"), few).select(*KEYS, F.when(F.col("full"), "full").otherwise("quick").alias("tier"))


CTES["wh_chosen"] = """
SELECT k.*, f.n, f.zero_share, f.insufficient, f.intermittent, f.last_28d, f.prev_28d, coalesce(b.method, 'insufficient') AS method, b.wape, b.bias,
       CASE b.method WHEN 'croston_sba' THEN p.croston_sba WHEN 'moving_average_28' THEN p.moving_average_28 WHEN 'exponential_smoothing' THEN p.exponential_smoothing ELSE f.mean END AS daily,
       CASE WHEN b.method IS NULL THEN greatest(f.sd, 0.5e0 * f.mean, 1e-9) ELSE greatest(b.residual_sd, 0.05e0 * greatest(CASE b.method WHEN 'croston_sba' THEN p.croston_sba WHEN 'moving_average_28' THEN p.moving_average_28
            ELSE p.exponential_smoothing END, 1e-9)) END AS sigma
FROM {wh_keys} k JOIN {wh_flags} f USING (product_id, location) LEFT JOIN {wh_best} b USING (product_id, location) JOIN {wh_point} p ON p.product_id = k.product_id AND p.location = k.location AND p.t = p.n
"""


@query("F14_P20_forecast_and_sigma", """
SELECT product_id, location, method, daily, sigma, CASE WHEN insufficient OR wape > 0.5 THEN 'low' WHEN wape > 0.25 THEN 'medium' ELSE 'high' END AS confidence FROM {wh_chosen}""", "daily sigma")
def _(t):
    return wh_chosen(t).select(*KEYS, "method", "daily", "sigma", replenish.confidence(F.col("wape"), F.col("insufficient")).alias("confidence"))


# ── schedule, events, balance ────────────────────────────────────────────────────────────────────────────────

CTES["wh_agenda"] = """
SELECT u.product_id, u.location, b.step, b.cases * u.qty / c.cases AS agenda FROM (SELECT hospital, product_id, warehouse AS location, sum(qty) AS qty FROM {history} WHERE ts > TIMESTAMP '2001-05-03 00:00:00' GROUP BY 1, 2, 3) u
JOIN (SELECT hospital, count(DISTINCT case_no) AS cases FROM {history} WHERE ts > TIMESTAMP '2001-05-03 00:00:00' GROUP BY 1) c USING (hospital)
JOIN (SELECT hospital, CAST(day - DATE '2001-08-01' AS INT) AS step, sum(cases) AS cases FROM {schedule} WHERE day > DATE '2001-08-01' AND day <= DATE '2001-08-31' GROUP BY 1, 2) b USING (hospital) WHERE u.location = u.hospital
"""
CTES["wh_fc"] = """
SELECT c.product_id, c.location, c.product, c.method, c.wape, CAST(s.step AS INT) AS step, CAST(DATE '2001-08-01' + INTERVAL '1' DAY * s.step AS DATE) AS day, c.daily AS forecast, greatest(0.0e0, c.daily - 1.6449e0 * c.sigma) AS lower,
       c.daily + 1.6449e0 * c.sigma AS upper, coalesce(a.agenda, 0) AS agenda, greatest(c.daily, coalesce(a.agenda, 0)) AS projected
FROM {wh_chosen} c CROSS JOIN (SELECT CAST(unnest(range(1, 31)) AS INT) AS step) s LEFT JOIN {wh_agenda} a ON a.product_id = c.product_id AND a.location = c.location AND a.step = s.step
"""


@query("A15_main_hospital", "SELECT location, hospital FROM (SELECT technician AS location, hospital, row_number() OVER (PARTITION BY technician ORDER BY count(*) DESC, hospital) AS rn FROM {history} GROUP BY 1, 2) WHERE rn = 1")
def _(t):
    return balance.main_hospitals(series.located(t.history, "technician"))


@query("J14_schedule_demand", "SELECT product_id, location, step, agenda FROM {wh_agenda}", "agenda")
def _(t):
    return wh_agenda(t)


@query("F15_schedule_floor", "SELECT * FROM {wh_fc}", "wape forecast lower upper agenda projected")
def _(t):
    return balance.with_agenda(methods.daily_forecasts(wh_chosen(t), CFG), wh_agenda(t))


CTES["wh_live"] = """
SELECT *, greatest(CAST(CAST(due_at AS DATE) - DATE '2001-08-01' AS INT), 0) AS t FROM {pending} WHERE confirmed AND NOT late AND due_at <= TIMESTAMP '2001-08-31 00:00:00'
"""
CTES["wh_events"] = """
SELECT product_id, split_part(to_location, '/', 1) AS location, t, ref, kind, supplier, qty FROM {wh_live}
UNION ALL SELECT product_id, split_part(from_location, '/', 1), t, ref, kind, supplier, -qty FROM {wh_live} WHERE kind = 'transfer'
"""


@query("F17_supply_events", "SELECT * FROM {wh_events}", "qty")
def _(t):
    return balance.supply_events(wh_pending(t), CFG)


CTES["terms"] = """
SELECT p.product_id, l.days AS supplier_days, u.purchase_unit, u.ratio, CASE WHEN p.product_id IN (2, 9) THEN 12.0e0 END AS own_multiple FROM (SELECT DISTINCT product_id FROM {history}) p
LEFT JOIN (SELECT product_id, delay AS days FROM (SELECT coalesce(product_id, template_id) AS product_id, delay, row_number() OVER (PARTITION BY coalesce(product_id, template_id) ORDER BY sequence, id) AS rn FROM {suppliers}) WHERE rn = 1) l USING (product_id)
LEFT JOIN (SELECT p.product_id, fp.name AS purchase_unit, fb.factor / fp.factor AS ratio FROM (SELECT p.*, coalesce(a.unit_id, b.unit_id) AS buy FROM {products} p
    LEFT JOIN (SELECT product_id, arg_min(unit_id, (sequence, id)) AS unit_id FROM {suppliers} WHERE unit_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1) a ON a.product_id = p.product_id
    LEFT JOIN (SELECT template_id, arg_min(unit_id, (sequence, id)) AS unit_id FROM {suppliers} WHERE unit_id IS NOT NULL GROUP BY 1) b ON b.template_id = p.template_id WHERE p.active) p
  JOIN {unit_factors} fb ON fb.unit_id = p.base_unit_id JOIN {unit_factors} fp ON fp.unit_id = p.buy WHERE p.buy <> p.base_unit_id) u USING (product_id)
"""
CTES["wh_stock"] = "SELECT product_id, warehouse AS location, sum(qty) AS stock_total, sum(usable) AS stock, sum(reserved) AS reserved FROM {stock} GROUP BY 1, 2"
_DC = "location IN ('NATION_0', 'NATION_5', 'NATION_10', 'NATION_15', 'NATION_20')"
CTES["wh_params"] = f"""
SELECT *, daily * lead_time + safety AS reorder_point, CAST(CASE WHEN is_dc THEN 30 ELSE least(30, floor(7 + lead_time)) END AS INT) AS win FROM (
  SELECT *, 1.6449e0 * sqrt(greatest(lead_time, 1) * sigma * sigma + daily * daily * lead_sigma * lead_sigma) AS safety FROM (
    SELECT c.*, t.supplier_days, t.purchase_unit, t.ratio, t.own_multiple, s.stock_total, s.stock, s.reserved, c.{_DC} AS is_dc, CASE WHEN c.{_DC} THEN coalesce(t.supplier_days, 7.0e0) ELSE 2.0e0 END AS lead_time,
           CASE WHEN c.{_DC} THEN 0.2e0 * coalesce(t.supplier_days, 7.0e0) ELSE 0.0e0 END AS lead_sigma
    FROM {{wh_chosen}} c LEFT JOIN {{terms}} t USING (product_id) LEFT JOIN {{wh_stock}} s USING (product_id, location)))
"""


def _balance_ctes(name: str, openings: str, demand: str, events: str, keys: str) -> None:
    """Day-by-day balance in SQL. openings(keys, opening, safety, win), demand(keys, step, qty), events(keys, t, qty)."""
    CTES[f"{name}_days"] = f"""
SELECT {keys}, t, demand, sum(flow - demand) OVER (PARTITION BY {keys} ORDER BY t) AS balance FROM (
  SELECT {keys}, t, sum(flow) AS flow, sum(demand) AS demand FROM (
    SELECT {keys}, 0 AS t, opening AS flow, 0.0e0 AS demand FROM ({openings}) UNION ALL SELECT {keys}, step, 0, qty FROM ({demand})
    UNION ALL SELECT e.* FROM (SELECT {keys}, greatest(t, 0), qty, 0 FROM ({events}) WHERE t <= 30) e SEMI JOIN ({openings}) o USING ({keys})) GROUP BY ALL)"""
    CTES[name] = f"""
SELECT d.*, CASE WHEN demand <= 0 THEN NULL WHEN stockout_day IS NULL THEN 30.0e0 WHEN stockout_day = 0 THEN 0.0e0 ELSE greatest(0, round(stockout_day - 1 + CASE WHEN q.demand > 0 THEN p.balance / q.demand ELSE 0 END, 2)) END AS coverage,
       CASE WHEN stockout_day IS NOT NULL THEN greatest(1, stockout_day - 1) END AS need_day FROM (
  SELECT {keys}, min(balance) AS lowest, arg_max(balance, t) AS closing, CAST(min(t) FILTER (balance < -1e-9) AS INT) AS stockout_day, CAST(min(t) FILTER (balance < safety - 1e-9) AS INT) AS below_safety_day, sum(demand) AS demand,
         greatest(0, max(safety) - min(balance)) AS shortfall, greatest(0, max(safety) - min(balance) FILTER (t <= win)) AS window_shortfall
  FROM {{{name}_days}} JOIN ({openings}) o USING ({keys}) GROUP BY {keys}) d
LEFT JOIN (SELECT {keys}, t AS stockout_day, demand FROM {{{name}_days}}) q USING ({keys}, stockout_day) LEFT JOIN (SELECT {keys}, t + 1 AS stockout_day, balance FROM {{{name}_days}}) p USING ({keys}, stockout_day)"""


# the joins above repeat `demand`; name the outer one explicitly
_balance_ctes("wh_balance", "SELECT product_id, location, coalesce(stock, 0) AS opening, safety, win FROM {wh_params}", "SELECT product_id, location, step, projected AS qty FROM {wh_fc}",
              "SELECT product_id, location, t, qty FROM {wh_events}", "product_id, location")
CTES["wh_balance"] = CTES["wh_balance"].replace("CASE WHEN demand <= 0", "CASE WHEN d.demand <= 0")


@query("F16_W07_W08_balance_projection", """
SELECT product_id, location, lowest, closing, stockout_day, below_safety_day, coverage, shortfall, window_shortfall, need_day FROM {wh_balance}""", "lowest closing coverage:2 shortfall window_shortfall")
def _(t):
    openings = wh_parameters(t).select(*KEYS, F.coalesce("stock", F.lit(0.0)).alias("opening"), "safety", "window")
    demand = wh_forecasts(t).select(*KEYS, "step", F.col("projected").alias("qty"))
    mine = wh_events(t).join(openings.select(*KEYS), KEYS, "left_semi")
    return balance.project(openings, demand, mine.select(*KEYS, "t", "qty"), KEYS, CFG.horizon).drop("events_beyond")


@query("C15_safety_and_reorder", "SELECT product_id, location, safety, reorder_point, lead_time FROM {wh_params}", "safety reorder_point lead_time")
def _(t):
    return replenish.local_parameters(wh_chosen(t), wh_terms(t), wh_stock(t), CFG).select(*KEYS, "safety", "reorder_point", "lead_time")


@query("A14_unit_cost", "SELECT product_id, sum(amount) / sum(qty) AS unit_cost FROM {history} GROUP BY 1", "unit_cost")
def _(t):
    return replenish.unit_costs(t.history)


@query("A03_stock_by_key", "SELECT product_id, warehouse, sum(qty) AS total, sum(available) AS available, sum(reserved) AS reserved, sum(usable) AS usable FROM {stock} GROUP BY 1, 2", "total available reserved usable")
def _(t):
    return stock_by(usable_stock(t.quants, AS_OF), "product_id", "warehouse")


CTES["costs_used"] = "SELECT product_id, sum(amount) / sum(qty) AS unit_cost FROM {history} GROUP BY 1"
_UP = "CASE WHEN lower(unit) = 'ml' THEN ceil({x} * 10 - 1e-9) / 10 ELSE ceil({x} - 1e-9) END"
CTES["wh_used"] = f"""
SELECT *, CASE WHEN stock IS NULL THEN 'no_stock_record' WHEN daily > 0 AND days_idle > 90 AND stock > 0 THEN 'no_movement' WHEN daily <= 0 THEN 'ok' WHEN stockout_day <= 1 THEN 'out_of_stock' WHEN stockout_day <= lead_time THEN 'critical'
       WHEN suggested > 0 AND (coalesce(stockout_day <= lead_time + 7, FALSE) OR coalesce(below_safety_day <= lead_time + 7, FALSE)) THEN 'reorder' WHEN stockout_day IS NULL AND stock / daily > 120 THEN 'excess' ELSE 'ok' END AS criticality FROM (
  SELECT *, CASE WHEN packs > 0 THEN {_UP.format(x='packs')} ELSE 0 END AS suggested FROM (
    SELECT p.*, b.* EXCLUDE (product_id, location), f.horizon_demand, f.committed, f.agenda_excess, f.agenda_days, coalesce(e.inbound, 0) AS inbound, coalesce(e.outbound, 0) AS outbound, e.first_arrival, coalesce(c.unit_cost, 0) AS unit_cost,
           CAST(DATE '2001-08-01' - p.last_used AS INT) AS days_idle,
           CASE WHEN b.window_shortfall > 0 THEN ceil(b.window_shortfall / coalesce(p.own_multiple, CASE WHEN p.is_dc AND p.ratio > 1 THEN p.ratio END, 1) - 1e-9) * coalesce(p.own_multiple, CASE WHEN p.is_dc AND p.ratio > 1 THEN p.ratio END, 1) ELSE 0 END AS packs
    FROM {{wh_params}} p JOIN {{wh_balance}} b ON b.product_id = p.product_id AND b.location = p.location
    JOIN (SELECT product_id, location, sum(projected) AS horizon_demand, sum(agenda) AS committed, sum(greatest(0, agenda - forecast)) AS agenda_excess, count(*) FILTER (agenda > 0) AS agenda_days FROM {{wh_fc}} GROUP BY 1, 2) f
      ON f.product_id = p.product_id AND f.location = p.location
    LEFT JOIN (SELECT product_id, location, sum(greatest(qty, 0)) AS inbound, sum(greatest(-qty, 0)) AS outbound, min(t) FILTER (qty > 0) AS first_arrival FROM {{wh_events}} GROUP BY 1, 2) e ON e.product_id = p.product_id AND e.location = p.location
    LEFT JOIN {{costs_used}} c ON c.product_id = p.product_id))
"""


@query("F18_P19_local_replenishment", """
SELECT product_id, location, stock, inbound, outbound, closing + horizon_demand AS projected_stock, stockout_day, need_day, first_arrival, daily AS daily_demand, sigma, safety AS safety_stock, reorder_point, horizon_demand, committed,
       agenda_excess, agenda_days, suggested, CASE WHEN ratio > 1 AND suggested > 0 THEN ceil(suggested / ratio) END AS suggested_packs, CASE WHEN daily > 0 THEN coverage END AS coverage, criticality, is_dc, suggested * unit_cost AS suggested_amount,
       stock * unit_cost AS stock_value, days_idle, CAST(DATE '2001-08-01' + INTERVAL '1' DAY * stockout_day AS DATE) AS stockout_date FROM {wh_used}""",
       "stock inbound outbound projected_stock daily_demand sigma safety_stock reorder_point horizon_demand committed agenda_excess suggested:4 suggested_packs coverage:2 suggested_amount:1 stock_value:1")
def _(t):
    return wh_used(t).select(
        *KEYS, "stock", "inbound", "outbound", "projected_stock", "stockout_day", "need_day", "first_arrival", "daily_demand", "sigma", "safety_stock", "reorder_point", "horizon_demand",
        "committed", "agenda_excess", "agenda_days", "suggested", "suggested_packs", "coverage", "criticality", "is_dc", "suggested_amount", "stock_value", "days_idle", "stockout_date")


CTES["wh_idle"] = f"""
SELECT s.product_id, s.location, s.stock, s.{_DC} AS is_dc, CASE WHEN s.{_DC} THEN 'source' ELSE 'no_movement' END AS criticality, s.stock + coalesce(e.moved, 0) AS projected_stock, s.stock * coalesce(c.unit_cost, 0) AS stock_value
FROM {{wh_stock}} s LEFT JOIN (SELECT product_id, location, sum(qty) AS moved FROM {{wh_events}} GROUP BY 1, 2) e USING (product_id, location) LEFT JOIN {{costs_used}} c USING (product_id)
WHERE s.stock > 0 AND NOT EXISTS (SELECT 1 FROM {{wh_keys}} k WHERE k.product_id = s.product_id AND k.location = s.location)
"""


@query("F19_J17_stock_without_consumption", """
SELECT s.product_id, s.location, s.stock, s.location IN ('NATION_0/OR', 'NATION_5/OR', 'NATION_10/OR') AS is_dc FROM (SELECT product_id, location, sum(usable) AS stock FROM {stock} GROUP BY 1, 2) s
WHERE s.stock > 0 AND NOT EXISTS (SELECT 1 FROM {history} h WHERE h.product_id = s.product_id AND h.sublocation = s.location AND h.ts > TIMESTAMP '2001-06-01 00:00:00')""", "stock")
def _(t):
    cfg = SupplyConfig(as_of=date(2001, 8, 1), dc_locations=("NATION_0/OR", "NATION_5/OR", "NATION_10/OR"))
    used = series.located(t.history, "sublocation").filter("ts > timestamp_ntz '2001-06-01 00:00:00'").select(*KEYS).distinct()
    stock = usable_stock(t.quants, AS_OF)
    names = t.history.groupBy("product_id").agg(F.min("product").alias("product"), F.min("unit").alias("unit"))
    none = wh_events(t).filter(F.lit(False))
    rows = replenish.stock_only_rows(used, stock, none, wh_terms(t), names, balance.main_hospitals(series.located(t.history, "sublocation")), wh_costs(t), cfg)
    return rows.select(*KEYS, "stock", "is_dc")


_balance_ctes("net_balance", "SELECT product_id, stock AS opening, safety, 30 AS win FROM {net_params}", "SELECT product_id, step, sum(projected) AS qty FROM {wh_fc} GROUP BY 1, 2",
              "SELECT product_id, t, qty FROM {wh_events} WHERE kind = 'purchase'", "product_id")
_days, _bal = CTES.pop("net_balance_days"), CTES.pop("net_balance")
CTES["net_params"] = """
SELECT *, 1.6449e0 * sqrt(greatest(lead_time, 1) * sigma * sigma + daily * daily * 0.2e0 * lead_time * 0.2e0 * lead_time) AS safety FROM (
  SELECT u.product_id, u.daily, u.sigma, u.horizon_demand, u.wape, u.unit, coalesce(s.stock, 0) AS stock, coalesce(t.supplier_days, 7.0e0) AS lead_time, t.ratio, t.own_multiple, t.purchase_unit, coalesce(c.unit_cost, 0) AS unit_cost FROM (
    SELECT product_id, min(unit) AS unit, sum(daily) AS daily, sqrt(sum(sigma * sigma)) AS sigma, sum(horizon_demand) AS horizon_demand, sum(wape * (last_28d + 1e-9)) / sum(last_28d + 1e-9) FILTER (wape IS NOT NULL) AS wape FROM {wh_used} GROUP BY 1) u
  LEFT JOIN (SELECT product_id, sum(stock) AS stock FROM {wh_stock} GROUP BY 1) s USING (product_id) LEFT JOIN {terms} t USING (product_id) LEFT JOIN {costs_used} c USING (product_id))
"""
CTES["net_balance_days"], CTES["net_balance"] = _days, _bal.replace("CASE WHEN demand <= 0", "CASE WHEN d.demand <= 0")
CTES["network"] = f"""
SELECT *, CASE WHEN daily <= 0 THEN 'ok' WHEN stockout_day <= 1 THEN 'out_of_stock' WHEN stockout_day <= lead_time THEN 'critical' WHEN below_safety_day <= lead_time + 7 THEN 'reorder' WHEN stockout_day IS NULL AND stock / daily > 120 THEN 'excess' ELSE 'ok' END AS criticality FROM (
  SELECT *, CASE WHEN packs > 0 THEN {_UP.format(x='packs')} ELSE 0 END AS suggested FROM (
    SELECT p.*, b.* EXCLUDE (product_id), CASE WHEN b.shortfall > 0 THEN ceil(b.shortfall / coalesce(own_multiple, CASE WHEN ratio > 1 THEN ratio END, 1) - 1e-9) * coalesce(own_multiple, CASE WHEN ratio > 1 THEN ratio END, 1) ELSE 0 END AS packs
    FROM {{net_params}} p JOIN {{net_balance}} b USING (product_id)))
"""


@query("F20_A19_network_replenishment", """
SELECT product_id, stock, daily AS daily_demand, sigma, lead_time, safety AS safety_stock, horizon_demand, suggested, CASE WHEN ratio > 1 AND suggested > 0 THEN ceil(suggested / ratio - 1e-9) END AS suggested_packs,
       purchase_unit IS NOT NULL AND ratio IS NULL AS conversion_missing, CASE WHEN stockout_day IS NOT NULL THEN ceil(lead_time) <= stockout_day END AS in_time, CAST(stockout_day - ceil(lead_time) AS INT) AS slack_days, stockout_day, coverage, wape, criticality,
       suggested * unit_cost AS suggested_amount FROM {network}""", "stock daily_demand sigma lead_time safety_stock horizon_demand suggested:3 suggested_packs coverage:2 wape suggested_amount:1")
def _(t):
    return wh_plan(t).filter("level = 'network'").select(
        "product_id", "stock", "daily_demand", "sigma", "lead_time", "safety_stock", "horizon_demand", "suggested", "suggested_packs", "conversion_missing", "in_time", "slack_days",
        "stockout_day", "coverage", "wape", "criticality", "suggested_amount")


@query("A20_network_forecast", "SELECT product_id, step, day, sum(forecast) AS forecast, sum(lower) AS lower, sum(upper) AS upper, sum(projected) AS projected, sum(agenda) AS agenda FROM {wh_fc} GROUP BY 1, 2, 3",
       "forecast lower upper projected agenda")
def _(t):
    return replenish.network_forecast(wh_forecasts(t))


@query("A33_forecast_pivot", "SELECT product_id, step, day, sum(projected) AS projected FROM {wh_fc} GROUP BY 1, 2, 3", "projected")
def _(t):
    return replenish.daily_by_product(wh_forecasts(t))


CTES["plan"] = """
SELECT product_id, location, 'local' AS level, criticality, coverage_shown AS coverage, suggested, suggested * unit_cost AS suggested_amount, stock * unit_cost AS stock_value, method, wape, bias, inbound, committed, last_28d, confidence, intermittent FROM (
  SELECT *, CASE WHEN daily > 0 THEN coverage END AS coverage_shown, CASE WHEN insufficient OR wape > 0.5 THEN 'low' WHEN wape > 0.25 THEN 'medium' ELSE 'high' END AS confidence FROM {wh_used})
UNION ALL SELECT product_id, location, 'local', criticality, NULL, 0, 0, stock_value, 'no local consumption', NULL, NULL, 0, 0, 0, 'n/a', FALSE FROM {wh_idle}
UNION ALL SELECT product_id, 'NETWORK (all locations)', 'network', criticality, CASE WHEN daily > 0 THEN coverage END, suggested, suggested * unit_cost, stock * unit_cost, 'sum of locations', wape, NULL, 0, 0, 0, 'x', FALSE FROM {network}
"""


@query("U02_O03_full_plan", "SELECT product_id, location, level, criticality, coverage, suggested FROM {plan}", "coverage:2 suggested:3")
def _(t):
    return replenish.ordered_plan(wh_plan(t)).select(*KEYS, "level", "criticality", "coverage", "suggested")


@query("P17_plan_view", "SELECT product_id, location, criticality, coverage FROM {plan} WHERE level = 'local' AND criticality = 'critical' ORDER BY coverage NULLS LAST, product_id, location LIMIT 25", "coverage:2")
def _(t):
    return replenish.plan_view(wh_plan(t), state="critical").select(*KEYS, "criticality", "coverage")


@query("A21_plan_summary", """
SELECT count(*) AS rows, count(*) FILTER (level = 'local' AND criticality = 'out_of_stock') AS out_of_stock, count(*) FILTER (level = 'local' AND criticality = 'critical') AS critical, count(*) FILTER (level = 'local' AND confidence = 'low') AS confidence_low,
       sum(suggested_amount) FILTER (level = 'network') AS purchase_amount, sum(suggested_amount) FILTER (level = 'local') AS internal_amount, sum(stock_value) FILTER (level = 'network') AS stock_value,
       count(*) FILTER (level = 'network' AND suggested > 0) AS products_to_buy, 100 * avg(wape) FILTER (level = 'local') AS wape_mean, 100 * sum(wape * (last_28d + 1e-9)) FILTER (level = 'local') / sum(last_28d + 1e-9) FILTER (level = 'local' AND wape IS NOT NULL) AS wape_weighted,
       100 * avg(bias) FILTER (level = 'local') AS bias_mean FROM {plan}""", "purchase_amount:0 internal_amount:0 stock_value:0 wape_mean wape_weighted bias_mean")
def _(t):
    return replenish.plan_summary(wh_plan(t)).select(
        "rows", "out_of_stock", "critical", "confidence_low", "purchase_amount", "internal_amount", "stock_value", "products_to_buy", "wape_mean", "wape_weighted", "bias_mean")


# ── classes, expiries, transfers ─────────────────────────────────────────────────────────────────────────────

CTES["abc"] = """
WITH recent AS (SELECT *, CAST(CAST(ts AS DATE) + INTERVAL '1' DAY * (7 - isodow(ts)) AS DATE) AS week FROM {history} WHERE ts > TIMESTAMP '2001-08-01 00:00:00' - INTERVAL '365' DAY),
v AS (SELECT product_id, min(product) AS product, sum(amount) AS amount FROM recent GROUP BY 1), r AS (SELECT *, amount / sum(amount) OVER () AS share FROM v),
run AS (SELECT *, sum(share) OVER (ORDER BY amount DESC, product_id ROWS UNBOUNDED PRECEDING) AS running FROM r),
span AS (SELECT product_id, min(week) AS a, max(week) AS b FROM recent GROUP BY 1), w AS (SELECT product_id, week, sum(qty) AS q FROM recent GROUP BY 1, 2),
dense AS (SELECT s.product_id, coalesce(w.q, 0) AS q FROM (SELECT product_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL '7' DAY)) AS DATE) AS week FROM span) s LEFT JOIN w USING (product_id, week)),
cv AS (SELECT product_id, stddev_samp(q) / avg(q) AS cv FROM dense GROUP BY 1)
SELECT run.*, cv.cv, CASE WHEN running <= 0.80 THEN 'A' WHEN running <= 0.95 THEN 'B' ELSE 'C' END AS abc, CASE WHEN round(cv, 2) < 0.5 THEN 'X' WHEN round(cv, 2) < 1.0 THEN 'Y' ELSE 'Z' END AS xyz FROM run LEFT JOIN cv USING (product_id)
"""


@query("A17_A18_W05_abc_xyz", "SELECT *, abc || xyz AS class FROM {abc}", "amount:2 share running cv")
def _(t):
    return classes.abc_xyz(wh_lines(t), F.expr(END)).drop("policy")


@query("F21_W06_J13_expiry_risk", """
SELECT product_id, location, lot, days_left, qty, earlier_qty, at_risk, at_risk * unit_cost AS at_risk_amount, CASE WHEN days_left < 0 THEN 'expired' WHEN days_left <= 30 THEN 'critical' ELSE 'risk' END AS status FROM (
  SELECT *, greatest(0, qty - greatest(0, daily * greatest(days_left, 0) - earlier_qty)) AS at_risk FROM (
    SELECT s.product_id, s.warehouse AS location, s.lot, s.qty, CAST(CAST(s.expiry AS DATE) - DATE '2001-08-01' AS INT) AS days_left, coalesce(k.daily, 0) AS daily, coalesce(c.unit_cost, 0) AS unit_cost,
           coalesce(sum(s.qty) OVER (PARTITION BY s.product_id, s.warehouse ORDER BY s.expiry, s.lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier_qty
    FROM {stock} s LEFT JOIN {wh_used} k ON k.product_id = s.product_id AND k.location = s.warehouse LEFT JOIN {costs_used} c ON c.product_id = s.product_id WHERE s.qty > 0)) WHERE days_left <= 180 AND (at_risk > 0 OR days_left < 0)""",
       "qty earlier_qty at_risk at_risk_amount:1")
def _(t):
    return classes.expiry_risk(wh_stock(t), wh_local(t), CFG).select(*KEYS, "lot", "days_left", "qty", "earlier_qty", "at_risk", "at_risk_amount", "status")


CTES["reserve"] = """
WITH placed AS (SELECT product_id, location, is_dc, daily, reorder_point, horizon_demand, CASE WHEN location = 'NATION_1' THEN 'WEST' WHEN location = 'NATION_2' THEN 'EAST' WHEN location LIKE '%NATION_1%' THEN 'WEST' WHEN location LIKE '%NATION_2%' THEN 'EAST' ELSE 'NATION' END AS region
  FROM (SELECT product_id, location, is_dc, daily, reorder_point, horizon_demand FROM {wh_used} UNION ALL SELECT product_id, location, is_dc, 0, 0, 0 FROM {wh_idle}))
SELECT p.product_id, p.location, p.region, CASE WHEN p.daily > 0 THEN p.reorder_point * 1.5e0 + p.horizon_demand ELSE 0 END + CASE WHEN p.is_dc THEN 7 * coalesce(CASE WHEN r.d > 0 THEN r.d END, n.d / greatest(c.k, 1), 0) ELSE 0 END AS reserve
FROM placed p LEFT JOIN (SELECT product_id, region, sum(daily) AS d FROM placed WHERE NOT is_dc AND daily > 0 GROUP BY 1, 2) r ON r.product_id = p.product_id AND r.region = p.region
LEFT JOIN (SELECT product_id, sum(daily) AS d FROM placed WHERE NOT is_dc AND daily > 0 GROUP BY 1) n ON n.product_id = p.product_id LEFT JOIN (SELECT product_id, count(*) AS k FROM placed WHERE is_dc GROUP BY 1) c ON c.product_id = p.product_id
"""


@query("F23_operating_reserve", "SELECT * FROM {reserve}", "reserve")
def _(t):
    return rebalance.operating_reserve(wh_local(t), CFG).select(*KEYS, "region", "reserve")


def wh_transfers(t):
    return stored(t.spark, t.folder, "wh-transfers", lambda: rebalance.propose_transfers(wh_local(t), CFG))


CTES["alloc_rows"] = """
SELECT r.product_id, r.location, r.region, r.reserve, coalesce(u.criticality, i.criticality) AS criticality, u.suggested, u.stockout_day, coalesce(u.is_dc, i.is_dc) AS is_dc, CASE WHEN u.product_id IS NULL THEN i.projected_stock ELSE u.closing + u.horizon_demand END AS projected
FROM {reserve} r LEFT JOIN {wh_used} u ON u.product_id = r.product_id AND u.location = r.location LEFT JOIN {wh_idle} i ON i.product_id = r.product_id AND i.location = r.location
"""
CTES["alloc_units"] = "SELECT product_id, CASE WHEN lower(min(unit)) = 'ml' THEN 10 ELSE 1 END AS f FROM {wh_used} GROUP BY 1"
CTES["alloc_need"] = """
SELECT product_id, location, region, f, CAST(ceil(suggested * f - 1e-9) AS BIGINT) AS missing, row_number() OVER (PARTITION BY product_id ORDER BY stockout_day IS NULL, stockout_day, CASE criticality WHEN 'out_of_stock' THEN 0 WHEN 'critical' THEN 1 ELSE 2 END, suggested DESC, location) AS n
FROM {alloc_rows} JOIN {alloc_units} USING (product_id) WHERE criticality IN ('out_of_stock', 'critical', 'reorder') AND suggested > 0
"""
CTES["alloc_source"] = """
SELECT product_id, location, region, reserve, f, CAST(floor(greatest(0, coalesce(projected, 0) - reserve) * f + 1e-9) AS BIGINT) AS cap,
       row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN is_dc THEN 0 WHEN criticality = 'excess' THEN 1 ELSE 2 END, coalesce(projected, 0) DESC, location) AS idx
FROM {alloc_rows} JOIN {alloc_units} USING (product_id) WHERE criticality IN ('excess', 'ok', 'no_movement', 'source')
"""
CTES["alloc_steps"] = """
SELECT product_id, CAST(0 AS BIGINT) AS n, idx, CAST(0 AS BIGINT) AS given, CAST(0 AS BIGINT) AS taken FROM {alloc_source}
UNION ALL SELECT product_id, n, idx, given + taken, taken FROM (
  SELECT a.product_id, d.n, a.idx, a.given, CAST(greatest(0, least(s.cap - a.given, d.missing - coalesce(sum(s.cap - a.given) OVER (PARTITION BY a.product_id ORDER BY CASE WHEN s.region = d.region THEN 0 ELSE 1 END, a.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
  FROM alloc_steps a JOIN {alloc_source} s ON s.product_id = a.product_id AND s.idx = a.idx JOIN {alloc_need} d ON d.product_id = a.product_id AND d.n = a.n + 1)
"""
CTES["moves"] = """
SELECT a.product_id, s.location AS origin, d.location AS destination, a.taken / CAST(s.f AS DOUBLE) AS qty, (s.cap - a.given + a.taken) / CAST(s.f AS DOUBLE) AS free_before, s.reserve
FROM {alloc_steps} a JOIN {alloc_source} s ON s.product_id = a.product_id AND s.idx = a.idx JOIN {alloc_need} d ON d.product_id = a.product_id AND d.n = a.n WHERE a.taken > 0
"""


@query("F22_J15_O08_rebalancing", """
SELECT m.*, m.qty * u.unit_cost AS amount, coalesce(u.stockout_day >= 2, TRUE) AS in_time, CAST(u.stockout_day - 2 AS INT) AS slack_days FROM {moves} m JOIN {wh_used} u ON u.product_id = m.product_id AND u.location = m.destination""", "qty free_before reserve amount:2")
def _(t):
    return wh_transfers(t).select("product_id", "origin", "destination", "qty", "free_before", "reserve", "amount", "in_time", "slack_days")


CTES["ends"] = """
SELECT product_id, origin, destination, 'destination' AS side, destination AS location, qty AS move FROM {moves} UNION ALL SELECT product_id, origin, destination, 'origin', origin, -qty FROM {moves}
"""
_END = "product_id, origin, destination, side"
_balance_ctes("moved_balance", f"SELECT {_END}, coalesce(stock, 0) AS opening, coalesce(safety, 0) AS safety, 30 AS win FROM {{ends}} LEFT JOIN {{wh_params}} USING (product_id, location)",
              f"SELECT {_END}, step, projected AS qty FROM {{ends}} JOIN {{wh_fc}} USING (product_id, location)",
              f"SELECT {_END}, t, qty FROM {{ends}} JOIN {{wh_events}} USING (product_id, location) UNION ALL SELECT {_END}, 2, move FROM {{ends}}", _END)
CTES["moved_balance"] = CTES["moved_balance"].replace("CASE WHEN demand <= 0", "CASE WHEN d.demand <= 0")


@query("F24_coverage_after_transfer", """
SELECT product_id, origin, destination, max(coverage) FILTER (side = 'destination') AS coverage_after, max(coverage) FILTER (side = 'origin') AS origin_coverage_after FROM {moved_balance} GROUP BY 1, 2, 3""", "coverage_after:2 origin_coverage_after:2")
def _(t):
    openings = wh_parameters(t).select(*KEYS, F.coalesce("stock", F.lit(0.0)).alias("opening"), "safety", "window")
    demand = wh_forecasts(t).select(*KEYS, "step", F.col("projected").alias("qty"))
    rows = rebalance.coverage_after(wh_transfers(t), openings, demand, wh_events(t).select(*KEYS, "t", "qty"), CFG)
    return rows.select("product_id", "origin", "destination", "coverage_after", "origin_coverage_after")


@query("W13_idle_and_recent_days", "SELECT product_id, location, CAST(DATE '2001-08-01' - last_used AS INT) AS days_idle, last_28d, prev_28d FROM {wh_keys} JOIN {wh_flags} USING (product_id, location)", "last_28d prev_28d")
def _(t):
    return wh_used(t).select(*KEYS, "days_idle", "last_28d", "prev_28d")


@query("A28_supply_kpis", "SELECT criticality, count(*) AS n, sum(stock_value) AS stock_value FROM {plan} WHERE level = 'local' GROUP BY 1", "stock_value:1")
def _(t):
    return wh_plan(t).filter("level = 'local'").groupBy("criticality").agg(F.count("*").alias("n"), F.sum("stock_value").alias("stock_value"))
