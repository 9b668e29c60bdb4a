"""Proposals, scenarios and evaluation of forecasts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from catalogue.registry import CTES, query
from catalogue.supply import CFG, END, KEYS, _balance_ctes, wh_events, wh_forecasts, wh_lines, wh_local, wh_plan, wh_transfers
from stockwarden.config import Policy
from stockwarden.operators import adhoc, classes, history, ledger, replenish, scenario
from stockwarden.sources import catalog
from stockwarden.sources.stock import usable_stock

AS_OF = datetime(2001, 8, 1)
POLICY = Policy(max_qty=5000.0, blocked_locations=("nation_13",), allowed_locations=("NATION",), max_amount=110000.0)

CTES["keyed"] = """
SELECT *, concat_ws('|', kind, product_id, 'origin=' || origin, 'destination=' || destination, 'location=' || location, 'lot=' || lot,
       CASE WHEN kind NOT IN ('transfer', 'purchase', 'reorder_rule') AND origin IS NULL AND destination IS NULL AND location IS NULL AND lot IS NULL THEN 't=' || left(sha1(title), 12) END) AS key FROM {proposals}
"""
CTES["policy_checked"] = """
SELECT *, len(blockers) = 0 AS allowed FROM (
  SELECT *, list_filter([CASE WHEN kind = 'unknown_kind' THEN 'kind not allowed: unknown_kind' END, CASE WHEN qty > 5000 THEN 'quantity above 5000' END, CASE WHEN amount > 110000 THEN 'amount above 110000.00' END,
    CASE WHEN lower(origin) LIKE '%nation_13%' THEN origin || ' is blocked' END, CASE WHEN lower(destination) LIKE '%nation_13%' THEN destination || ' is blocked' END, CASE WHEN lower(location) LIKE '%nation_13%' THEN location || ' is blocked' END],
    lambda x: x IS NOT NULL) AS blockers,
    CASE WHEN kind = 'alert' THEN 'low' WHEN amount >= 50000 OR qty >= 2500 THEN 'high' WHEN kind IN ('purchase', 'reorder_rule', 'quarantine') THEN 'medium' WHEN amount < 10000 THEN 'low' ELSE 'medium' END AS new_risk FROM {proposals})
"""


@query("P21_policy_evaluation", """
SELECT id, allowed, new_risk AS risk, array_to_string(list_concat(blockers, CASE WHEN new_risk = 'high' THEN ['high risk: an administrator must approve'] ELSE [] END), '; ') AS reasons FROM {policy_checked}""")
def _(t):
    return ledger.evaluate(t.proposals, POLICY).select("id", "allowed", "risk", F.array_join("reasons", "; ").alias("reasons"))


@query("P22_priority_notes", """
SELECT id, CAST(needed_on - DATE '2001-08-01' AS INT) AS days_to_need, CASE WHEN needed_on IS NULL THEN CASE WHEN criticality IN ('out_of_stock', 'critical') THEN 'high' ELSE 'normal' END
  WHEN needed_on - DATE '2001-08-01' <= 1 THEN 'immediate' WHEN needed_on - DATE '2001-08-01' <= 3 THEN 'high' WHEN needed_on - DATE '2001-08-01' <= 7 THEN 'medium' ELSE 'normal' END AS priority,
  CAST(CASE WHEN NOT in_time THEN 1 ELSE 0 END + CASE WHEN origin_short AND kind = 'transfer' THEN 1 ELSE 0 END + CASE WHEN covered_before > 0 THEN 1 ELSE 0 END AS INT) AS notes FROM {proposals}""")
def _(t):
    return ledger.with_priority(t.proposals, CFG.as_of).select("id", "days_to_need", "priority", F.size("depends_on").alias("notes"))


_CRIT = "CASE criticality WHEN 'out_of_stock' THEN 0 WHEN 'critical' THEN 1 WHEN 'reorder' THEN 2 ELSE 5 END"
_KIND = "CASE kind WHEN 'transfer' THEN 0 WHEN 'purchase' THEN 1 WHEN 'reorder_rule' THEN 2 WHEN 'alert' THEN 5 ELSE 9 END"
_PENDING = "status IN ('proposed', 'partly_approved', 'needs_review')"


@query("O07_decision_order", f"SELECT id FROM {{proposals}} WHERE {_PENDING}")
def _(t):
    rows = ledger.with_priority(ledger.pending(t.proposals), CFG.as_of)
    return rows.orderBy(*ledger.decision_order(rows)).select("id")


@query("A32_decision_groups", f"""
SELECT title, count(*) AS proposals, sum(amount) AS amount, CAST(least(9, min(d), min(c) + 10) AS INT) AS urgency, CAST(least(999, min(d)) AS INT) AS days_to_need, ['low', 'medium', 'high'][max(r)] AS highest_risk FROM (
  SELECT * EXCLUDE (title), CASE kind WHEN 'transfer' THEN 'transfer: ' || destination ELSE kind END AS title,
         coalesce(needed_on - DATE '2001-08-01', 999) AS d, {_CRIT} AS c, CASE risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS r FROM {{proposals}} WHERE {_PENDING}) GROUP BY 1""", "amount:2")
def _(t):
    return ledger.decision_groups(ledger.with_priority(ledger.pending(t.proposals), CFG.as_of))


CTES["held"] = f"""
SELECT * FROM {{proposals}} WHERE kind IN ('transfer', 'purchase', 'quarantine', 'scrap') AND qty > 0 AND ({_PENDING} OR status IN ('approved', 'executing', 'approved_manual')
  OR (status IN ('executed', 'late') AND coalesce(doc_state, 'draft') NOT IN ('confirmed', 'assigned', 'partially_available', 'waiting', 'done', 'cancel', 'purchase') AND doc_ref NOT IN (SELECT ref FROM {{pending}})))
"""


@query("A26_J18_commitments_ledger", """
SELECT 'origin' AS side, product_id, origin AS location, sum(qty) AS qty FROM {held} WHERE kind IN ('transfer', 'quarantine') AND origin IS NOT NULL GROUP BY 2, 3
UNION ALL SELECT 'destination', product_id, destination, sum(qty) FROM {held} WHERE kind = 'transfer' GROUP BY 2, 3 UNION ALL SELECT 'network', product_id, NULL, sum(qty) FROM {held} WHERE kind = 'purchase' GROUP BY 2""", "qty")
def _(t):
    sides = ledger.commitments(ledger.active(t.proposals, reported_refs=t.pending))
    rows = [df.select(F.lit(side).alias("side"), "product_id", (F.col("location") if side != "network" else F.lit(None).cast("string")).alias("location"), "qty") for side, df in sides.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("A24_money_by_stage", f"""
SELECT sum(amount) FILTER ({_PENDING} AND kind IN ('transfer', 'purchase')) AS proposed, count(*) FILTER ({_PENDING}) AS n_proposed,
       sum(amount) FILTER (status IN ('approved', 'executing', 'approved_manual') AND kind IN ('transfer', 'purchase')) AS approved, count(*) FILTER (status IN ('approved', 'executing', 'approved_manual')) AS n_approved,
       sum(amount) FILTER (status IN ('executed', 'concluded', 'late') AND kind IN ('transfer', 'purchase')) AS executed, count(*) FILTER (status IN ('executed', 'concluded', 'late')) AS n_executed FROM {{proposals}}""", "proposed:2 approved:2 executed:2")
def _(t):
    return ledger.money_by_stage(t.proposals)


@query("A25_count_by_status", "SELECT status, count(*) AS n FROM {proposals} GROUP BY 1")
def _(t):
    return ledger.count_by_status(t.proposals)


@query("W14_superseded_proposals", f"""
SELECT id, key, kept_id FROM (SELECT id, key, max(id) OVER (PARTITION BY key) AS kept_id FROM {{keyed}} WHERE {_PENDING} AND kind IN ('transfer', 'purchase', 'reorder_rule')) WHERE id < kept_id""")
def _(t):
    return ledger.superseded(t.proposals)


CTES["still_valid"] = f"""
SELECT DISTINCT key FROM {{keyed}} k WHERE {_PENDING} AND ((kind = 'purchase' AND product_id IN (SELECT product_id FROM {{network}} WHERE suggested > 0))
  OR (kind IN ('transfer', 'reorder_rule') AND EXISTS (SELECT 1 FROM {{wh_used}} u WHERE u.product_id = k.product_id AND u.location = CASE WHEN k.kind = 'transfer' THEN k.destination ELSE k.location END AND u.criticality IN ('out_of_stock', 'critical', 'reorder') AND u.suggested > 0)))
"""


@query("U05_still_valid_needs", "SELECT key FROM {still_valid}")
def _(t):
    return ledger.still_valid(t.proposals, wh_plan(t))


@query("U05_no_longer_needed", f"SELECT id, key FROM {{keyed}} WHERE {_PENDING} AND kind IN ('transfer', 'purchase', 'reorder_rule') AND last_run <> 3 AND key NOT IN (SELECT key FROM {{still_valid}})")
def _(t):
    return ledger.no_longer_needed(t.proposals, ledger.still_valid(t.proposals, wh_plan(t)), 3).select("id", "key")


CTES["lot_stock"] = "SELECT product_id, warehouse AS location, lot, qty, reserved FROM {stock}"


@query("J24_recheck", f"""
WITH firm AS (SELECT product_id, origin, sum(qty) AS f FROM {{proposals}} WHERE kind IN ('transfer', 'quarantine') AND origin IS NOT NULL AND (status IN ('approved', 'executing', 'approved_manual')
    OR (status IN ('executed', 'late') AND coalesce(doc_state, 'draft') NOT IN ('confirmed', 'assigned', 'partially_available', 'waiting', 'done', 'cancel', 'purchase'))) GROUP BY 1, 2),
place AS (SELECT product_id, location AS origin, sum(qty - reserved) AS free FROM {{lot_stock}} GROUP BY 1, 2), lots AS (SELECT product_id, location AS origin, lot, sum(qty - reserved) AS free FROM {{lot_stock}} GROUP BY 1, 2, 3),
bought AS (SELECT DISTINCT product_id FROM {{purchase_lines}} WHERE state = 'done' AND planned BETWEEN TIMESTAMP '2001-07-18 00:00:00' AND TIMESTAMP '2001-08-01 00:00:00'),
r AS (SELECT p.*, p.kind IN ('transfer', 'quarantine') AS moves, coalesce(CASE WHEN kind = 'quarantine' THEN l.free ELSE s.free END, 0) - coalesce(f.f, 0) AS av, b.product_id IS NOT NULL AS dup FROM {{policy_checked}} p
  LEFT JOIN place s ON s.product_id = p.product_id AND s.origin = p.origin LEFT JOIN lots l ON l.product_id = p.product_id AND l.origin = p.origin AND l.lot = p.lot LEFT JOIN firm f ON f.product_id = p.product_id AND f.origin = p.origin
  LEFT JOIN bought b ON b.product_id = p.product_id WHERE {_PENDING}),
c AS (SELECT *, CASE WHEN unit = 'mL' THEN floor(av * 10 + 1e-9) / 10 ELSE floor(av + 1e-9) END AS capped, created_at < TIMESTAMP '2001-07-25 00:00:00' AS old FROM r)
SELECT id, kind, CASE WHEN old THEN 'expired' WHEN NOT allowed THEN 'blocked' WHEN moves AND av <= 0 THEN 'needs_review' WHEN moves AND av < qty AND (100 * (qty - av) / qty > 10 OR capped <= 0) THEN 'needs_review'
  WHEN kind = 'purchase' AND dup THEN 'needs_review' ELSE 'ok' END AS verdict, CASE WHEN moves THEN av END AS available, CASE WHEN NOT old AND allowed AND moves AND av < qty AND av > 0 THEN capped ELSE qty END AS qty FROM c""", "available qty")
def _(t):
    stock = usable_stock(t.quants, AS_OF).withColumn("location", F.col("warehouse"))
    recent = t.purchase_lines.filter("state = 'done'").select("product_id", F.col("planned").alias("created_at"))
    return ledger.recheck(t.proposals, stock, recent, POLICY, AS_OF)


CTES["docs"] = """
SELECT o.order_ref AS ref, min(o.order_state) AS state, sum(l.ordered) AS ordered, sum(l.received) AS received, min(l.planned) AS planned FROM {purchase_lines} l JOIN {purchase_orders} o ON o.order_id = l.order_id GROUP BY 1
UNION ALL SELECT ref, CASE WHEN min(state) = max(state) THEN min(state) ELSE 'waiting' END, sum(qty_doc), 0, min(due_at) FROM {transfer_moves} GROUP BY 1
"""


def docs(t):
    bought = t.purchase_lines.join(t.purchase_orders.drop("planned"), "order_id").groupBy(F.col("order_ref").alias("ref")).agg(
        F.min("order_state").alias("state"), F.sum("ordered").alias("ordered"), F.sum("received").alias("received"), F.min("planned").alias("planned"))
    moved = t.transfer_moves.groupBy("ref").agg(
        F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("waiting").alias("state"), F.sum("qty_doc").alias("ordered"), F.lit(0.0).alias("received"), F.min("due_at").alias("planned"))
    return bought.unionByName(moved)


@query("J25_follow_up", """
SELECT p.id, p.kind, p.status, CASE WHEN p.kind = 'alert' AND d.ref IS NULL THEN 'concluded' WHEN d.ref IS NULL OR d.state = 'cancel' THEN 'cancelled_at_source' WHEN CASE WHEN p.doc_kind = 'purchase' THEN d.ordered > 0 AND d.received >= d.ordered ELSE d.state = 'done' END THEN 'concluded'
  WHEN coalesce(CAST(p.needed_on AS TIMESTAMP), d.planned) < TIMESTAMP '2001-08-01 00:00:00' AND p.status <> 'late' THEN 'late' ELSE p.status END AS new_status, d.state AS seen_state FROM {proposals} p LEFT JOIN {docs} d ON d.ref = p.doc_ref WHERE p.status IN ('executed', 'late')""")
def _(t):
    return ledger.follow_up(t.proposals, docs(t), AS_OF)


@query("J23_location_ids", """
WITH loc AS (SELECT DISTINCT sublocation AS name FROM {consumption} UNION SELECT DISTINCT hospital FROM {consumption} UNION SELECT concat('WARD/', n_name) FROM {nation}), ids AS (SELECT name, CAST(row_number() OVER (ORDER BY name) AS INT) AS location_id FROM loc),
want AS (SELECT DISTINCT lower(hospital) AS name FROM {consumption} UNION SELECT DISTINCT sublocation FROM {consumption} UNION SELECT 'or' UNION SELECT 'nation_3'),
c AS (SELECT w.name, i.location_id, CASE WHEN i.name = w.name THEN 0 WHEN lower(i.name) = lower(w.name) THEN 1 WHEN ends_with(lower(i.name), '/' || lower(w.name)) THEN 2 END AS tier FROM want w JOIN ids i ON lower(i.name) = lower(w.name) OR ends_with(lower(i.name), '/' || lower(w.name)))
SELECT name, location_id, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, location_id) AS rn FROM c) WHERE rn = 1""")
def _(t):
    names = t.consumption.select(F.col("sublocation").alias("name")).union(t.consumption.select("hospital")).union(t.nation.select(F.concat(F.lit("WARD/"), "n_name"))).distinct()
    places = adhoc.numbered(names, "name", "location_id").withColumn("location_id", F.col("location_id").cast("int"))
    extra = t.nation.select(F.explode(F.array(F.lit("or"), F.lit("nation_3"))).alias("name"))
    wanted = t.consumption.select(F.lower("hospital").alias("name")).union(t.consumption.select("sublocation")).union(extra).distinct()
    return ledger.resolve_locations(wanted, places)


def _places(t):
    return t.nation.select(F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("name"))


def _needs(t):
    sides = ledger.commitments(ledger.active(t.proposals, reported_refs=t.pending))
    abc = classes.abc_xyz(wh_lines(t), F.expr(END))
    return ledger.propose_from_plan(wh_plan(t), wh_transfers(t), abc, t.proposals, sides["network"], catalog.lead_times(t.suppliers), _places(t))


_ROUNDED = "CASE WHEN lower(unit) = 'ml' THEN ceil({x} * 10 - 1e-9) / 10 ELSE ceil({x} - 1e-9) END"
CTES["residuals"] = f"""
SELECT product_id, {_ROUNDED.format(x='left_over')} AS qty FROM (
  SELECT n.product_id, n.unit, greatest(0, n.suggested - coalesce(h.qty, 0)) AS left_over FROM {{network}} n LEFT JOIN (SELECT product_id, sum(qty) AS qty FROM {{held}} WHERE kind = 'purchase' GROUP BY 1) h USING (product_id) WHERE n.suggested > 0) WHERE left_over > 0
"""
CTES["rules"] = f"""
SELECT u.product_id, u.location, {_ROUNDED.format(x='reorder_point')} AS minimum, {_ROUNDED.format(x='(reorder_point + daily * 14)')} AS maximum FROM {{wh_used}} u
WHERE criticality IN ('out_of_stock', 'critical', 'reorder') AND product_id IN (SELECT product_id FROM {{abc}} WHERE xyz IN ('X', 'Y'))
"""
CTES["plan_needs"] = f"""
SELECT kind, key, product_id, n.qty + CASE WHEN kind = 'reorder_rule' THEN 0 ELSE coalesce(w.qty, 0) END AS qty, w.qty IS NOT NULL AS reused FROM (
  SELECT 'transfer' AS kind, concat_ws('|', 'transfer', product_id, 'origin=' || origin, 'destination=' || destination) AS key, product_id, qty FROM {{moves}}
  UNION ALL SELECT 'purchase', concat_ws('|', 'purchase', product_id), product_id, qty FROM {{residuals}}
  UNION ALL SELECT 'reorder_rule', concat_ws('|', 'reorder_rule', product_id, 'location=' || location), product_id, maximum FROM {{rules}}) n
LEFT JOIN (SELECT key, arg_max(qty, id) AS qty FROM {{keyed}} WHERE {_PENDING} GROUP BY 1) w USING (key)
"""


@query("F27_proposals_from_plan", "SELECT kind, key, qty, reused FROM {plan_needs}", "qty:3")
def _(t):
    return ledger.within_run_limit(_needs(t), POLICY).select("kind", "key", "qty", "reused")


@query("F27_purchase_residuals", "SELECT product_id, qty, reused FROM {plan_needs} WHERE kind = 'purchase'", "qty:3")
def _(t):
    return _needs(t).filter("kind = 'purchase'").select("product_id", "qty", "reused")


@query("F27_min_max_rules", "SELECT * FROM {rules}", "minimum maximum")
def _(t):
    return _needs(t).filter("kind = 'reorder_rule'").select("product_id", "location", "minimum", "maximum")


@query("F28_J27_material_changes", f"""
SELECT *, CASE WHEN stored_id IS NULL THEN 'new' WHEN new_qty IS NULL THEN 'absent' WHEN abs(new_qty - old_qty) / old_qty * 100 > 2 THEN 'updated' ELSE 'unchanged' END AS change FROM (
  SELECT key, n.qty AS new_qty, o.stored_id, o.old_qty FROM {{plan_needs}} n FULL JOIN (SELECT key, max(id) AS stored_id, arg_max(qty, id) AS old_qty FROM {{keyed}} WHERE {_PENDING} GROUP BY 1) o USING (key))""", "new_qty:3 old_qty:3")
def _(t):
    return ledger.changes(_needs(t), t.proposals, POLICY)


CTES["free_stock"] = """
SELECT r.product_id, r.location, coalesce(u.stock, i.stock) AS stock, coalesce(u.criticality, i.criticality) AS criticality, r.reserve, coalesce(h.qty, 0) AS committed, greatest(0, coalesce(u.stock, i.stock) - r.reserve - coalesce(h.qty, 0)) AS free
FROM {reserve} r LEFT JOIN {wh_used} u ON u.product_id = r.product_id AND u.location = r.location LEFT JOIN {wh_idle} i ON i.product_id = r.product_id AND i.location = r.location
LEFT JOIN (SELECT product_id, origin AS location, sum(qty) AS qty FROM {held} WHERE kind IN ('transfer', 'quarantine') AND origin IS NOT NULL GROUP BY 1, 2) h ON h.product_id = r.product_id AND h.location = r.location
WHERE coalesce(u.stock, i.stock) IS NOT NULL
"""


def _free(t):
    origin = ledger.commitments(ledger.active(t.proposals, reported_refs=t.pending))["origin"]
    return ledger.free_at_origin(wh_local(t), origin, CFG)


@query("J18_free_at_origin", "SELECT product_id, location, criticality, stock, reserve, committed, free FROM {free_stock}", "stock reserve committed free")
def _(t):
    return _free(t)


@query("F31_quantity_changes", f"""
WITH c AS (SELECT product_id, origin, sum(qty) AS committed FROM {{proposals}} WHERE kind IN ('transfer', 'quarantine') AND origin IS NOT NULL AND qty > 0 AND ({_PENDING} OR status IN ('approved', 'executing', 'approved_manual')
    OR (status IN ('executed', 'late') AND coalesce(doc_state, 'draft') NOT IN ('confirmed', 'assigned', 'partially_available', 'waiting', 'done', 'cancel', 'purchase'))) GROUP BY 1, 2),
r AS (SELECT p.id, p.kind, p.unit, p.qty AS old_qty, p.amount / p.qty AS cost, p.origin, p.destination, CASE WHEN p.unit = 'mL' THEN ceil(p.qty * 15 - 1e-9) / 10 ELSE ceil(p.qty * 1.5e0 - 1e-9) END AS asked,
    CASE WHEN p.kind = 'transfer' AND f.stock IS NOT NULL THEN greatest(0, f.stock - f.reserve - (coalesce(c.committed, 0) - p.qty)) END AS room
  FROM {{proposals}} p LEFT JOIN {{free_stock}} f ON f.product_id = p.product_id AND f.location = p.origin LEFT JOIN c ON c.product_id = p.product_id AND c.origin = p.origin WHERE {_PENDING} AND p.kind IN ('transfer', 'purchase')),
k AS (SELECT *, CASE WHEN asked > room THEN CASE WHEN unit = 'mL' THEN floor(room * 10 + 1e-9) / 10 ELSE floor(room + 1e-9) END ELSE asked END AS capped,
    CASE WHEN asked > room THEN CASE WHEN unit = 'mL' THEN ceil((asked - room) * 10 - 1e-9) / 10 ELSE ceil(asked - room - 1e-9) END ELSE 0 END AS missing_at_origin FROM r),
v AS (SELECT *, capped > 0 AND abs(capped - old_qty) >= 1.0 AS changed, CASE WHEN capped > 0 AND abs(capped - old_qty) >= 1.0 THEN capped ELSE old_qty END AS qty FROM k)
SELECT id, old_qty, qty, missing_at_origin, changed, qty * cost AS amount, CASE WHEN qty * cost >= 50000 OR qty >= 2500 THEN 'high' WHEN kind = 'purchase' THEN 'medium' WHEN qty * cost < 10000 THEN 'low' ELSE 'medium' END AS risk,
  qty <= 5000 AND qty * cost <= 110000 AND coalesce(origin, '') <> 'NATION_13' AND coalesce(destination, '') <> 'NATION_13' AS allowed FROM v""", "old_qty qty:2 missing_at_origin:2 amount:6")
def _(t):
    asked = ledger.pending(t.proposals).select("id", (F.col("qty") * 1.5).alias("qty"))
    return ledger.adjust_quantities(t.proposals, asked, wh_local(t), POLICY, CFG).select("id", "old_qty", "qty", "missing_at_origin", "changed", "amount", "risk", "allowed")


# ── scenarios and evaluation ─────────────────────────────────────────────────────────────────────────────────


def _flows(t):
    return scenario.proposal_flows(ledger.active(t.proposals, reported_refs=t.pending), CFG)


CTES["flows"] = """
SELECT product_id, destination AS location, 2 AS t, qty FROM {held} WHERE kind = 'transfer' AND destination IS NOT NULL
UNION ALL SELECT product_id, origin, 2, -qty FROM {held} WHERE kind IN ('transfer', 'quarantine') AND origin IS NOT NULL
"""
_OPEN = "SELECT product_id, location, coalesce(stock, 0) AS opening, safety, win FROM {wh_used} WHERE daily > 0"


def _scenario_ctes(name: str, factor: str, extra_join: str, delayed: str) -> str:
    """Base and changed balances in SQL; returns the text of the rows that get worse."""
    CTES[f"{name}_demand"] = f"SELECT f.product_id, f.location, f.step, f.projected AS qty, f.projected * {factor} AS new_qty FROM {{wh_fc}} f JOIN {{wh_used}} u ON u.product_id = f.product_id AND u.location = f.location {extra_join}"
    for side, qty, t in (("base", "qty", "t"), ("new", "new_qty", delayed)):
        _balance_ctes(f"{name}_{side}", _OPEN, f"SELECT product_id, location, step, {qty} AS qty FROM {{{name}_demand}}",
                      f"SELECT product_id, location, {t} AS t, qty FROM {{wh_events}} UNION ALL SELECT product_id, location, t, qty FROM {{flows}}", "product_id, location")
        CTES[f"{name}_{side}"] = CTES[f"{name}_{side}"].replace("CASE WHEN demand <= 0", "CASE WHEN d.demand <= 0")
    state = lambda s, d: (f"CASE WHEN {d} <= 0 THEN 3 WHEN {s}.stockout_day <= 1 THEN 0 WHEN {s}.stockout_day <= u.lead_time THEN 1 WHEN {s}.window_shortfall > 0 AND (coalesce({s}.stockout_day <= u.lead_time + 7, FALSE) "  # noqa: E731
                          f"OR coalesce({s}.below_safety_day <= u.lead_time + 7, FALSE)) THEN 2 ELSE 3 END")
    return f"""
SELECT u.product_id, u.location, b.stockout_day AS base_stockout, n.stockout_day AS new_stockout, n.coverage AS new_coverage, greatest(0, n.shortfall - b.shortfall) AS residual_shortfall, n.shortfall
FROM {{wh_used}} u JOIN {{{name}_base}} b ON b.product_id = u.product_id AND b.location = u.location JOIN {{{name}_new}} n ON n.product_id = u.product_id AND n.location = u.location WHERE u.daily > 0
AND ({state('n', 'n.demand')} < {state('b', 'b.demand')} OR (n.stockout_day IS NOT NULL AND (b.stockout_day IS NULL OR n.stockout_day < b.stockout_day)))"""


_WORSE = ["product_id", "location", "base_stockout", "new_stockout", "new_coverage", "residual_shortfall", "shortfall"]


@query("F25_scenario_demand_and_delays", _scenario_ctes(
    "surge", "CASE WHEN f.step BETWEEN 3 AND 20 THEN CASE WHEN f.location = 'NATION_7' THEN 1.4e0 ELSE 1.0e0 END * CASE WHEN f.product LIKE 'volatile%' THEN 1.2e0 ELSE 1.0e0 END ELSE 1.0e0 END", "",
    "CASE WHEN qty > 0 AND ref LIKE 'PO%' THEN t + 5 ELSE t END"), "new_coverage:2 residual_shortfall shortfall")
def _(t):
    what_if = scenario.Scenario("surge", {"NATION_7": 1.4, "volatile": 1.2}, {"PO": 5}, first_day=3, last_day=20)
    return scenario.simulate(wh_local(t), wh_forecasts(t), wh_events(t), what_if, CFG, _flows(t)).select(*_WORSE)


@query("F25_scenario_without_change", "SELECT product_id, location FROM {wh_used} WHERE FALSE")
def _(t):
    return scenario.simulate(wh_local(t), wh_forecasts(t), wh_events(t), scenario.Scenario("none"), CFG, _flows(t)).select(*KEYS)


CTES["busy"] = """
SELECT s.hospital, min(CAST(day - DATE '2001-08-01' AS INT)) AS first, max(CAST(day - DATE '2001-08-01' AS INT)) AS last FROM {schedule} s WHERE day > DATE '2001-08-01' AND day <= DATE '2001-08-31'
AND hospital IN (SELECT hospital FROM (SELECT hospital, sum(cases) / count(DISTINCT day) AS per_day FROM {schedule} GROUP BY 1) JOIN {typical} USING (hospital) WHERE per_day / typical >= 0.3) GROUP BY 1
"""


@query("F26_schedule_growth", _scenario_ctes("growth", "CASE WHEN f.step BETWEEN y.first AND y.last THEN 1.8e0 ELSE 1.0e0 END", "LEFT JOIN {busy} y ON y.hospital = u.location", "t"), "new_coverage:2 residual_shortfall shortfall")
def _(t):
    load = history.scheduled_load(t.schedule, history.typical_cases(t.history))
    return scenario.schedule_growth(wh_local(t), wh_forecasts(t), wh_events(t), load, t.schedule, CFG, min_ratio=0.3, growth=1.8, proposals=_flows(t)).select(*_WORSE)


@query("F26_preventive_transfers", """
WITH d AS (
  SELECT u.product_id, u.location, sum(u.suggested) OVER (PARTITION BY u.product_id ORDER BY u.stockout_day NULLS LAST, u.location ROWS UNBOUNDED PRECEDING) AS n_end, u.suggested FROM {wh_used} u
  WHERE u.criticality IN ('out_of_stock', 'critical') AND u.suggested > 0 AND u.product_id IN (SELECT product_id FROM {network} WHERE suggested > 0 AND ceil(lead_time) > stockout_day)),
s AS (
  SELECT product_id, location, free, sum(free) OVER (PARTITION BY product_id ORDER BY round(free, 6) DESC, location DESC ROWS UNBOUNDED PRECEDING) AS s_end FROM {free_stock}
  WHERE criticality IN ('excess', 'ok', 'source', 'no_movement') AND free > 0)
SELECT d.product_id, s.location AS origin, d.location AS destination, least(n_end, s_end) - greatest(n_end - suggested, s_end - free) AS qty FROM d JOIN s USING (product_id)
WHERE least(n_end, s_end) - greatest(n_end - suggested, s_end - free) > 1e-9""", "qty")
def _(t):
    return scenario.preventive_transfers(wh_plan(t), _free(t)).select("product_id", "origin", "destination", "qty")


@query("F26_low_confidence_rows", "SELECT product_id, location FROM (SELECT * FROM {plan} WHERE level = 'local' AND confidence = 'low' AND criticality IN ('critical', 'reorder', 'out_of_stock'))")
def _(t):
    return scenario.low_confidence(wh_plan(t)).select(*KEYS)


CTES["errors"] = """
SELECT f.product_id, f.location, f.product, f.forecast, coalesce(a.actual, 0) AS actual, f.forecast - coalesce(a.actual, 0) AS error, CASE WHEN a.actual <> 0 THEN 100 * abs(f.forecast - a.actual) / a.actual END AS wape
FROM (SELECT product_id, location, min(product) AS product, sum(forecast) AS forecast FROM {wh_fc} WHERE day < DATE '2001-08-21' GROUP BY 1, 2) f
LEFT JOIN (SELECT product_id, warehouse AS location, sum(qty) AS actual FROM {consumption} WHERE day BETWEEN DATE '2001-08-02' AND DATE '2001-08-20' GROUP BY 1, 2) a USING (product_id, location)
"""


def _errors(t):
    return scenario.forecast_errors(wh_forecasts(t), t.consumption.withColumn("location", F.col("warehouse")), date(2001, 8, 21))


@query("F29_J12_forecast_errors", "SELECT product_id, location, forecast, actual, error, wape FROM {errors}", "forecast actual error wape")
def _(t):
    return _errors(t).select(*KEYS, "forecast", "actual", "error", "wape")


@query("A35_O10_accuracy_by_product", "SELECT product, 100 * sum(abs(error)) / greatest(sum(actual), 1e-9) AS wape, 100 * sum(error) / greatest(sum(actual), 1e-9) AS bias, count(*) AS keys FROM {errors} WHERE wape IS NOT NULL GROUP BY 1 ORDER BY wape DESC, product LIMIT 8", "wape bias")
def _(t):
    return scenario.accuracy(_errors(t), "product").orderBy(F.desc("wape"), "product").limit(8)


@query("A35_overall_accuracy", "SELECT 100 * sum(abs(error)) / greatest(sum(actual), 1e-9) AS wape, 100 * sum(error) / greatest(sum(actual), 1e-9) AS bias, count(*) AS keys FROM {errors} WHERE wape IS NOT NULL", "wape bias")
def _(t):
    return scenario.accuracy(_errors(t))


@query("J19_U06_alerts_between_runs", """
SELECT product_id, location, was, now, CASE WHEN was IS NULL THEN 'new' ELSE 'resolved' END AS change FROM (
  SELECT product_id, location, b.criticality AS was, n.criticality AS now FROM (SELECT product_id, location, criticality FROM {wh_used} WHERE criticality IN ('out_of_stock', 'critical', 'reorder') AND product_id % 3 <> 0) b
  FULL JOIN (SELECT product_id, location, CASE WHEN product_id % 3 = 1 THEN 'ok' ELSE criticality END AS criticality FROM {wh_used} UNION ALL SELECT product_id, location, CASE WHEN product_id % 3 = 1 THEN 'ok' ELSE criticality END FROM {wh_idle}) n USING (product_id, location))
WHERE (was IS NULL AND now IN ('out_of_stock', 'critical', 'reorder')) OR (was IS NOT NULL AND coalesce(now IN ('ok', 'excess'), TRUE))""")
def _(t):
    before = wh_local(t).withColumn("criticality", F.when(F.col("product_id") % 3 == 0, "ok").otherwise(F.col("criticality")))
    now = wh_local(t).withColumn("criticality", F.when(F.col("product_id") % 3 == 1, "ok").otherwise(F.col("criticality")))
    return replenish.compare_runs(before, now)


@query("W16_U04_latest_version", "SELECT user_id, ts, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn = 1")
def _(t):
    stamped = t.events.select("user_id", "ts", "event_id", "props", F.struct("ts", "event_id").alias("version"))
    return ledger.newest_version(stamped, "user_id", "version").drop("version")
