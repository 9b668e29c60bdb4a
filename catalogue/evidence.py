"""Evidence, learning, surveillance, incremental reading and sinks."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from catalogue.consumption import CFG, findings_of, lines_of, patterns_of
from catalogue.registry import CTES, query
from catalogue.supply import KEYS, wh_local, wh_pending, wh_plan, wh_stock
from catalogue.views import stored
from stockwarden.operators import evidence, fuse, learning, ledger, replenish
from stockwarden.session import shared_dir
from stockwarden.sources import tables
from stockwarden.sources.stock import usable_stock
from stockwarden.streaming import incremental, surveillance, versioned

AS_OF = datetime(2001, 8, 1)
#: How many targets one run may investigate; only the query of the investigation budget applies it.
CASES = 24


def _known(t):
    return findings_of(t).filter("severity = 'high'").select("fingerprint")


def targets_of(t):
    return stored(t.spark, t.folder, "targets", lambda: evidence.targets(findings_of(t), patterns_of(t), _known(t)))


CTES["targets"] = """
SELECT * FROM (
  SELECT * FROM (SELECT 'pattern|' || rule || '|' || coalesce(CAST(product_id AS VARCHAR), 'None') || '|' || key AS fingerprint, 'pattern' AS kind, rule AS methods, dimension, key, NULL AS case_no, product_id, product, hospital,
    CASE WHEN dimension = 'technician' THEN actor END AS technician, CASE WHEN dimension = 'doctor' THEN actor END AS doctor, NULL AS lot, CASE WHEN dimension = 'sublocation' THEN key END AS sublocation, NULL::TIMESTAMP AS ts, severity, risk_amount, 0 AS tier
    FROM {patterns} WHERE severity IN ('critical', 'high'))
  UNION ALL SELECT * FROM (SELECT fingerprint, 'finding', methods, NULL, NULL, case_no, product_id, product, hospital, technician, doctor, lot, sublocation, ts, severity, risk_amount, 1 FROM {findings} WHERE severity IN ('critical', 'high')))
WHERE fingerprint NOT IN (SELECT fingerprint FROM {findings} WHERE severity = 'high')
"""


@query("O06_investigation_targets", "SELECT fingerprint, kind, methods, case_no, product, hospital, technician, severity FROM {targets} ORDER BY tier, risk_amount DESC, fingerprint LIMIT 24")
def _(t):
    rows = evidence.targets(findings_of(t), patterns_of(t), _known(t), CASES)
    return rows.select("fingerprint", "kind", F.array_join("methods", ",").alias("methods"), "case_no", "product", "hospital", "technician", "severity")


@query("D01_case_content", "SELECT case_no, min(ts) AS ts, min(hospital) AS hospital, min(technician) AS technician, count(*) AS lines, sum(amount) AS amount FROM {enriched} WHERE case_no IN (SELECT case_no FROM {targets}) GROUP BY 1", "amount:2")
def _(t):
    return evidence.case_content(lines_of(t), targets_of(t))["header"].select("case_no", "ts", "hospital", "technician", "lines", "amount")


@query("D01_case_lines", "SELECT case_no, line_id, qty FROM {enriched} WHERE case_no IN (SELECT case_no FROM {targets})", "qty")
def _(t):
    return evidence.case_content(lines_of(t), targets_of(t))["lines"].select("case_no", "line_id", "qty")


CTES["people"] = "SELECT DISTINCT CASE WHEN dimension IN ('technician', 'doctor') THEN dimension WHEN technician <> '' THEN 'technician' ELSE 'doctor' END AS dimension, CASE WHEN dimension = 'doctor' OR coalesce(technician, '') = '' THEN doctor ELSE technician END AS name, product FROM {targets} WHERE dimension IN ('technician', 'doctor') OR technician <> '' OR doctor <> ''"
CTES["actor_lines"] = "SELECT e.*, d.dimension, CASE d.dimension WHEN 'technician' THEN e.technician ELSE e.doctor END AS name, CASE WHEN duration_min > 0 THEN qty / duration_min END AS any_rate FROM {enriched} e JOIN (VALUES ('technician'), ('doctor')) d(dimension) ON TRUE WHERE ts > today - INTERVAL '90' DAY"


CTES["actors"] = """
WITH base AS (SELECT dimension, name, count(DISTINCT case_no) AS cases, count(DISTINCT case_no) FILTER (doctor = '') AS cases_no_doctor, count(*) FILTER (night OR weekend) AS odd_lines FROM {actor_lines} JOIN (SELECT DISTINCT dimension, name FROM {people}) p USING (dimension, name) GROUP BY 1, 2),
home AS (SELECT dimension, name, hospital AS home FROM (SELECT dimension, name, hospital, row_number() OVER (PARTITION BY dimension, name ORDER BY count(*) DESC, hospital) AS rn FROM {actor_lines} GROUP BY 1, 2, 3) WHERE rn = 1),
own AS (SELECT dimension, name, product, count(*) AS lines, quantile_cont(any_rate, 0.5) AS rate_median FROM {actor_lines} JOIN {people} USING (dimension, name, product) GROUP BY 1, 2, 3),
peers AS (SELECT p.dimension, p.name, p.product, count(DISTINCT a.name) AS peers, quantile_cont(a.any_rate, 0.5) AS peer_rate FROM {people} p JOIN home h ON h.dimension = p.dimension AND h.name = p.name JOIN {actor_lines} a ON a.dimension = p.dimension AND a.product = p.product AND a.hospital = h.home AND a.name <> p.name GROUP BY 1, 2, 3)
SELECT b.*, h.home, o.product, o.lines, o.rate_median, r.peers, r.peer_rate FROM base b JOIN home h USING (dimension, name) LEFT JOIN own o USING (dimension, name) LEFT JOIN peers r ON r.dimension = o.dimension AND r.name = o.name AND r.product = o.product
"""


@query("D02_actor_history", "SELECT * FROM {actors}", "rate_median peer_rate")
def _(t):
    rows = evidence.actor_history(lines_of(t), evidence.actors(targets_of(t)))
    return rows.select("dimension", "name", "cases", "cases_no_doctor", "odd_lines", "home", "product", "lines", "rate_median", "peers", "peer_rate")


CTES["readings"] = """
SELECT e.case_no, e.product, e.line_id, (weight_start - weight_end) AS grams, CASE WHEN qty <> 0 THEN 100 * ((weight_start - weight_end) / 1.5e0 - qty) / qty END AS diff_pct, weight_end > weight_start AS inconsistent FROM {enriched} e JOIN (SELECT DISTINCT case_no, product FROM {targets}) t USING (case_no, product) WHERE weight_start IS NOT NULL
"""


@query("D03_scale_readings", "SELECT case_no, line_id, grams, diff_pct, inconsistent FROM {readings}", "grams diff_pct")
def _(t):
    return evidence.scale_readings(lines_of(t), targets_of(t), CFG).select("case_no", "line_id", "grams", "diff_pct", "inconsistent")


CTES["mismatches"] = """
SELECT technician, count(*) AS weighings, 100 * count(*) FILTER (abs((weight_start - weight_end) / 1.5e0 - qty) / qty > 0.15e0) / count(*) AS mismatch_pct FROM {enriched} WHERE weight_start IS NOT NULL AND qty > 0 AND technician IN (SELECT technician FROM {targets}) GROUP BY 1
"""


@query("D03_technician_mismatch", "SELECT * FROM {mismatches}", "mismatch_pct")
def _(t):
    return evidence.technician_mismatch(lines_of(t), targets_of(t), CFG)


CTES["lot_places"] = """
SELECT lot, hospital, lines, qty, first_value(hospital) OVER (PARTITION BY lot ORDER BY lines DESC, hospital) AS usual_hospital FROM (SELECT lot, hospital, count(*) AS lines, sum(qty) AS qty FROM {enriched} WHERE ts > today - INTERVAL '120' DAY AND lot IN (SELECT lot FROM {targets}) GROUP BY 1, 2)
"""


@query("D04_lot_history", "SELECT * FROM {lot_places}", "qty")
def _(t):
    return evidence.lot_history(lines_of(t), targets_of(t)).select("lot", "hospital", "lines", "qty", "usual_hospital")


@query("D05_lot_stock", "SELECT lot, product_id, location, qty, reserved FROM {stock} WHERE lot IN (SELECT lot FROM {targets})", "qty reserved")
def _(t):
    return evidence.lot_stock(usable_stock(t.quants, AS_OF), targets_of(t)).select("lot", "product_id", "location", "qty", "reserved")


CTES["target_days"] = "SELECT DISTINCT hospital, CAST(ts AS DATE) AS day FROM {targets} WHERE ts IS NOT NULL"


@query("D06_day_context", """
SELECT hospital, day, cases, cases_no_doctor, typical, technicians FROM (SELECT hospital, CAST(ts AS DATE) AS day, count(DISTINCT case_no) AS cases, count(DISTINCT case_no) FILTER (doctor = '') AS cases_no_doctor, string_agg(DISTINCT technician, ',' ORDER BY technician) AS technicians
  FROM {enriched} WHERE (hospital, CAST(ts AS DATE)) IN (SELECT (hospital, day) FROM {target_days}) GROUP BY 1, 2)
JOIN (SELECT hospital, quantile_cont(cases, 0.5) AS typical FROM (SELECT hospital, CAST(ts AS DATE) AS day, count(DISTINCT case_no) AS cases FROM {enriched} GROUP BY 1, 2) GROUP BY 1) USING (hospital)""", "typical")
def _(t):
    rows = evidence.day_context(lines_of(t), targets_of(t))["days"]
    return rows.select("hospital", "day", "cases", "cases_no_doctor", "typical", F.array_join("technicians", ",").alias("technicians"))


@query("D06_day_products", """
SELECT * FROM (SELECT hospital, day, product, qty, CAST(row_number() OVER (PARTITION BY hospital, day ORDER BY qty DESC, product) AS INT) AS rank FROM (SELECT hospital, CAST(ts AS DATE) AS day, product, sum(qty) AS qty FROM {enriched}
  WHERE (hospital, CAST(ts AS DATE)) IN (SELECT (hospital, day) FROM {target_days}) GROUP BY 1, 2, 3)) WHERE rank <= 6""", "qty")
def _(t):
    return evidence.day_context(lines_of(t), targets_of(t))["products"]


CTES["periods"] = """
SELECT w.dimension, w.key, w.product, count(*) FILTER (ts > today - INTERVAL '30' DAY) AS lines, count(DISTINCT case_no) FILTER (ts > today - INTERVAL '30' DAY) AS cases, count(*) FILTER (ts <= today - INTERVAL '30' DAY) / 3 AS lines_before,
       quantile_cont(CASE WHEN duration_min > 0 THEN qty / duration_min END, 0.5) FILTER (ts > today - INTERVAL '30' DAY) AS rate, count(DISTINCT case_no) FILTER (ts <= today - INTERVAL '30' DAY) < 5 AS history_insufficient
FROM {enriched} e JOIN (SELECT DISTINCT dimension, key, product FROM {targets} WHERE dimension IS NOT NULL) w ON e.product = w.product AND w.key = CASE w.dimension WHEN 'technician' THEN e.technician WHEN 'doctor' THEN e.doctor WHEN 'sublocation' THEN e.sublocation ELSE e.hospital END
WHERE ts > today - INTERVAL '120' DAY GROUP BY 1, 2, 3
"""


@query("D07_compare_periods", "SELECT * FROM {periods}", "lines_before rate")
def _(t):
    return evidence.compare_periods(lines_of(t), targets_of(t)).select("dimension", "key", "product", "lines", "cases", "lines_before", "rate", "history_insufficient")


CTES["old_cases"] = "SELECT line_id AS case_id, product, hospital, technician, doctor, lot, CASE WHEN length(methods) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM {findings}"
CTES["case_entities"] = " UNION ".join(f"SELECT case_id, {e} AS entity FROM {{old_cases}} WHERE {e} <> ''" for e in evidence.ENTITIES)
CTES["target_entities"] = " UNION ".join(f"SELECT fingerprint, {e} AS entity FROM {{targets}} WHERE {e} <> ''" for e in evidence.ENTITIES)


@query("D08_J21_similar_cases", """
SELECT fingerprint, case_id, score FROM (SELECT fingerprint, case_id, shared + CASE WHEN status = 'resolved' THEN 2 ELSE 0 END AS score, row_number() OVER (PARTITION BY fingerprint ORDER BY shared + CASE WHEN status = 'resolved' THEN 2 ELSE 0 END DESC, case_id DESC) AS rn
  FROM (SELECT fingerprint, case_id, count(*) AS shared FROM {case_entities} JOIN {target_entities} USING (entity) GROUP BY 1, 2) JOIN {old_cases} USING (case_id)) WHERE rn <= 5""")
def _(t):
    cases = findings_of(t).select(F.col("line_id").alias("case_id"), *evidence.ENTITIES, F.when(F.length(F.array_join("methods", ",")) % 3 == 0, "resolved").otherwise("open").alias("status"))
    return evidence.similar_cases(targets_of(t), cases).select("fingerprint", "case_id", "score")


CTES["notes"] = """
SELECT event_id AS note_id, CASE event_type WHEN 'click' THEN 'actor' WHEN 'view' THEN 'product_hospital' WHEN 'error' THEN 'hospital' ELSE 'case' END AS scope, concat('T', user_id % 5, '-', event_id % 4) AS technician, '' AS doctor,
       CASE WHEN user_id % 16 < 4 THEN concat('volatile agent ', user_id % 16, ' 250 mL') ELSE concat('supply ', user_id % 16) END AS product, concat('NATION_', event_id % 25) AS hospital, '' AS lot, value > 10 AS active, event_type AS key, props AS note FROM {events}
"""


@query("D09_J20_clarifications", """
SELECT DISTINCT t.fingerprint, n.note_id FROM {targets} t JOIN {notes} n ON (n.scope = 'actor' AND n.technician = t.technician) OR (n.scope = 'product_hospital' AND n.product = t.product AND n.hospital = t.hospital) OR (n.scope = 'hospital' AND n.hospital = t.hospital)""")
def _(t):
    from catalogue.views import Tables

    notes = Tables(t.spark, t.folder)._view(CTES["notes"])
    return evidence.applicable_clarifications(targets_of(t), notes).select("fingerprint", "note_id")


@query("D14_active_notes", "SELECT note_id, scope, key FROM {notes} WHERE active AND scope = 'actor'")
def _(t):
    return evidence.active_notes(t._view(CTES["notes"]), "actor").select("note_id", "scope", "key")


def _evidence(t):
    lines, rows = lines_of(t), targets_of(t)
    return {
        "readings": evidence.scale_readings(lines, rows, CFG), "history": evidence.actor_history(lines, evidence.actors(rows)), "lots": evidence.lot_history(lines, rows),
        "days": evidence.day_context(lines, rows)["days"],
    }


_HYPOTHESES = ", ".join(
    f"({n}, '{rule}', '{evidence.CAUSES[kind][0]}', '{evidence.CAUSES[kind][1]}', {', '.join(str(m) for m in evidence.SPEAKS.get(kind, (0, 0)))})"
    for rule, kinds in evidence.RULE_CAUSES.items() for n, kind in enumerate(kinds))
CTES["seen_by"] = """
SELECT t.fingerprint, t.methods, t.product, t.case_no, t.technician, t.dimension, t.key, CASE WHEN t.technician <> '' THEN t.technician ELSE t.doctor END AS name, r.ok, r.off, r.n AS n_scale, l.lot IS NOT NULL AS has_lot, d.day IS NOT NULL AS has_day
FROM {targets} t LEFT JOIN (SELECT case_no, product, bool_or(round_even(diff_pct, 0) <= 0) AS ok, bool_or(abs(round_even(diff_pct, 0)) > 15) AS off, least(count(*), 2) AS n FROM {readings} GROUP BY 1, 2) r ON r.case_no = t.case_no AND r.product = t.product
LEFT JOIN (SELECT DISTINCT lot FROM {lot_places}) l ON l.lot = t.lot LEFT JOIN {target_days} d ON d.hospital = t.hospital AND d.day = CAST(t.ts AS DATE)
"""
CTES["signals"] = """
SELECT s.fingerprint, s.methods, CASE WHEN ok THEN 1 ELSE 0 END + CASE WHEN off THEN 2 ELSE 0 END + CASE WHEN has_day OR a.name IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN has_day THEN 8 ELSE 0 END + CASE WHEN has_lot THEN 16 ELSE 0 END AS bits
FROM {seen_by} s LEFT JOIN (SELECT DISTINCT name FROM {actors}) a USING (name)
"""


@query("D10_hypotheses", f"""
SELECT fingerprint, hypothesis, "check", in_favour, against, CASE WHEN in_favour > 0 AND against = 0 THEN 'high' WHEN against > 0 AND in_favour = 0 THEN 'low' ELSE 'medium' END AS plausibility,
       CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY in_favour - against DESC, method_order, position) AS INT) AS rank FROM (
  SELECT m.fingerprint, m.method_order, h.position, h.hypothesis, h."check", bit_count(m.bits & h.f) AS in_favour, bit_count(m.bits & h.a) AS against, row_number() OVER (PARTITION BY m.fingerprint, h.hypothesis ORDER BY m.method_order, h.position) AS rn FROM (
    SELECT fingerprint, bits, i AS method_order, string_split(methods, ',')[i + 1] AS method FROM (SELECT *, unnest(range(len(string_split(methods, ',')))) AS i FROM {{signals}})) m
  JOIN (VALUES {_HYPOTHESES}) h(position, rule, hypothesis, "check", f, a) ON h.rule = CASE WHEN m.method LIKE 'z\\_%' ESCAPE '\\' THEN 'z' ELSE m.method END) WHERE rn = 1""")
def _(t):
    return evidence.rank_hypotheses(evidence.signals(targets_of(t), **_evidence(t)))


@query("D10_evidence_confidence", """
SELECT fingerprint, evidence, CASE WHEN evidence >= 4 AND NOT coalesce(history_insufficient, FALSE) THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT s.fingerprint, p.history_insufficient, CAST(CASE WHEN s.case_no IS NOT NULL THEN 1 + CASE WHEN m.technician IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END + coalesce(s.n_scale, 0) + CASE WHEN a.name IS NOT NULL THEN 1 + a.beside ELSE 0 END
    + CASE WHEN has_lot THEN 1 ELSE 0 END + CASE WHEN has_day THEN 1 ELSE 0 END + CASE WHEN p.history_insufficient IS NOT NULL THEN 1 ELSE 0 END AS INT) AS evidence
  FROM {seen_by} s LEFT JOIN (SELECT name, product, max(CASE WHEN rate_median IS NOT NULL AND peer_rate IS NOT NULL THEN 1 ELSE 0 END) AS beside FROM {actors} GROUP BY 1, 2) a ON a.name = s.name AND a.product = s.product
  LEFT JOIN {mismatches} m ON m.technician = s.technician LEFT JOIN {periods} p ON p.dimension = s.dimension AND p.key = s.key AND p.product = s.product)""")
def _(t):
    lines, rows = lines_of(t), targets_of(t)
    return evidence.evidence_confidence(rows, **_evidence(t), mismatch=evidence.technician_mismatch(lines, rows, CFG), periods=evidence.compare_periods(lines, rows))


@query("D11_case_actions", """
SELECT DISTINCT fingerprint, action, team FROM (SELECT t.fingerprint, t.product_id, t.lot, t.sublocation, unnest(string_split(t.methods, ',')) AS method FROM {targets} t) x JOIN (VALUES ('R09_EXPIRED_LOT', 'quarantine', '', 'lot'), ('R09_EXPIRED_LOT', 'team_notice', 'quality', 'lot'),
  ('R08_DUPLICATE', 'team_notice', 'billing', 'case'), ('R04_NO_SURGERY', 'team_notice', 'billing', 'case'), ('R01_OVER_CONTAINER', 'team_notice', 'billing', 'case'), ('R10_LEVEL_SHIFT', 'count_request', '', 'place'), ('R11_ACTOR_DEVIATION', 'count_request', '', 'place'),
  ('R03_SCALE_MISMATCH', 'count_request', '', 'place'), ('R10_LEVEL_SHIFT', 'team_notice', 'operations', 'product'), ('R11_ACTOR_DEVIATION', 'team_notice', 'operations', 'product'), ('R03_SCALE_MISMATCH', 'team_notice', 'operations', 'product')) a(method, action, team, needs) USING (method)
WHERE CASE needs WHEN 'lot' THEN product_id IS NOT NULL AND lot <> '' WHEN 'case' THEN TRUE WHEN 'place' THEN product_id IS NOT NULL AND sublocation <> '' ELSE product_id IS NOT NULL END""")
def _(t):
    return evidence.case_actions(targets_of(t))


CTES["feedback"] = """
SELECT event_id, ts AS labelled_at, user_id * 1000 + event_id % 40 AS finding_id, CASE event_type WHEN 'click' THEN 'justified' WHEN 'error' THEN 'confirmed' WHEN 'view' THEN 'reviewed' WHEN 'purchase' THEN 'discarded' ELSE 'justified' END AS status,
       user_id % 16 AS product_id, concat('NATION_', user_id % 25) AS hospital, concat('D', user_id % 10) AS doctor FROM {events}
"""
CTES["deltas"] = """
SELECT *, row_number() OVER (PARTITION BY scope, key, metric ORDER BY labelled_at, event_id) AS i FROM (
  SELECT d.*, s.scope, CASE s.scope WHEN 'product' THEN CAST(product_id AS VARCHAR) WHEN 'product_hospital' THEN product_id || '|' || hospital ELSE product_id || '|' || doctor END AS key, m.metric FROM (
    SELECT *, ROUND(e - coalesce(lag(e) OVER (PARTITION BY finding_id ORDER BY labelled_at, event_id), 0), 2) AS delta FROM (SELECT *, CASE WHEN status IN ('justified', 'discarded') THEN 0.15e0 WHEN status = 'confirmed' THEN -0.15e0 ELSE 0.0e0 END AS e FROM {feedback})) d
  CROSS JOIN (VALUES ('product'), ('product_hospital'), ('product_doctor')) s(scope) CROSS JOIN (VALUES ('qty'), ('rate')) m(metric) WHERE delta <> 0)
"""
CTES["shifts"] = """
SELECT scope, key, metric, i, CAST(delta AS DOUBLE) AS x FROM {deltas} WHERE i = 1
UNION ALL SELECT d.scope, d.key, d.metric, d.i, greatest(-1.5e0, least(1.5e0, s.x + d.delta)) FROM shifts s JOIN {deltas} d ON d.scope = s.scope AND d.key = s.key AND d.metric = s.metric AND d.i = s.i + 1
"""


@query("D12_feedback_thresholds", """
SELECT s.scope, s.key, s.metric, s.x AS threshold_adj, k.justified, k.confirmed FROM {shifts} s JOIN (SELECT scope, key, metric, max(i) AS i, count(*) FILTER (delta > 0) AS justified, count(*) FILTER (delta < 0) AS confirmed FROM {deltas} GROUP BY 1, 2, 3) k USING (scope, key, metric, i)""", "threshold_adj")
def _(t):
    return learning.threshold_shifts(learning.label_changes(t._view(CTES["feedback"])))


@query("D15_briefing", """
SELECT 'consumption' AS part, 'critical' AS measure, CAST(count(*) AS DOUBLE) AS value FROM {findings} WHERE severity = 'critical' UNION ALL SELECT 'consumption', 'patterns', count(*) FROM {patterns}
UNION ALL SELECT 'supply', 'at_risk', count(*) FROM {plan} WHERE level = 'local' AND criticality IN ('out_of_stock', 'critical') UNION ALL SELECT 'decisions', 'pending', count(*) FROM {proposals} WHERE status IN ('proposed', 'partly_approved', 'needs_review')""", "value")
def _(t):
    from stockwarden.plans.briefing import briefing

    return briefing(fuse.run_kpis(lines_of(t), findings_of(t), patterns_of(t)), replenish.plan_summary(wh_plan(t)), t.proposals)


# ── surveillance and incremental reading ─────────────────────────────────────────────────────────────────────

_PRINT = "left(sha1(concat_ws('|', {parts})), 14) AS fingerprint"
CTES["alerts"] = f"""
SELECT 'no_surgery' AS kind, qty AS value, {_PRINT.format(parts="'sc', case_no, product_id, printf('%.3f', qty)")} FROM {{history}} WHERE ts >= TIMESTAMP '2001-07-31 00:00:00' AND ts <= TIMESTAMP '2001-08-01 00:00:00' AND unit = 'mL' AND (doctor = '' OR NOT coalesce(duration_min > 0, FALSE))
UNION ALL SELECT 'below_reorder', s.now, {_PRINT.format(parts="'ro', u.product_id, u.location, CAST(s.now < u.reorder_point * 0.5e0 AS INT)")} FROM {{wh_used}} u JOIN (SELECT product_id, warehouse AS location, sum(usable) * 0.6e0 AS now FROM {{stock}} GROUP BY 1, 2) s USING (product_id, location)
  WHERE u.reorder_point > 0 AND u.criticality IN ('ok', 'excess') AND s.now < u.reorder_point
UNION ALL SELECT 'late_delivery', qty, {_PRINT.format(parts="'et', ref, product_id")} FROM {{pending}} WHERE late
UNION ALL SELECT 'extraordinary_load', per_day, {_PRINT.format(parts="'jx', hospital, first_day")} FROM (SELECT hospital, min(day) AS first_day, sum(cases) / count(DISTINCT day) AS per_day FROM {{schedule}} WHERE day > DATE '2001-08-01' AND day <= DATE '2001-08-04' GROUP BY 1) s
  JOIN (SELECT hospital, quantile_cont(cases, 0.5) AS typical FROM (SELECT hospital, CAST(ts AS DATE) AS day, count(DISTINCT case_no) AS cases FROM {{history}} WHERE ts > TIMESTAMP '2001-06-02 00:00:00' AND ts <= TIMESTAMP '2001-08-01 00:00:00' GROUP BY 1, 2) GROUP BY 1) y USING (hospital) WHERE per_day / typical >= 1.5
UNION ALL SELECT 'undecided', n, {_PRINT.format(parts="'ap', n, '2001-08-01'")} FROM (SELECT count(*) AS n FROM {{proposals}} WHERE status IN ('proposed', 'partly_approved', 'needs_review') AND created_at <= TIMESTAMP '2001-07-27 00:00:00') WHERE n > 0
"""


def _alerts(t):
    less = wh_stock(t).withColumn("usable", F.col("usable") * 0.6)
    return surveillance.all_alerts(t.history, wh_local(t), less, wh_pending(t), t.schedule, t.proposals, AS_OF)


@query("X03_J26_surveillance_alerts", "SELECT kind, fingerprint, min(value) AS value FROM {alerts} GROUP BY 1, 2", "value:4")
def _(t):
    return _alerts(t).select("kind", "fingerprint", "value")


@query("X04_alert_once", "SELECT DISTINCT fingerprint FROM {alerts} WHERE kind <> 'late_delivery'")
def _(t):
    root = f"{shared_dir(t.spark)}/alerts-{uuid.uuid4().hex}"
    surveillance.raise_alerts(_alerts(t).filter("kind = 'late_delivery'"), root, datetime(2001, 7, 30))
    return surveillance.raise_alerts(_alerts(t), root, AS_OF).select("fingerprint")


def event_stream(t):
    """The events as a stream of several files in write order."""
    path = f"{shared_dir(t.spark)}/events-{uuid.uuid4().hex}"
    t.events.repartitionByRange(4, "ts").write.parquet(path)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("X01_incremental_snapshot", "SELECT user_id, event_id, ts, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn = 1")
def _(t):
    root = f"{shared_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    run = incremental.start_snapshot(event_stream(t), f"{root}/state", f"{root}/checkpoint", "user_id", ["ts", "event_id"])
    run.awaitTermination()
    return versioned.snapshot(t.spark, f"{root}/state").select("user_id", "event_id", "ts", "props")


@query("X01_changed_ids", """
SELECT user_id, CASE WHEN s.last IS NULL THEN 'new' ELSE 'changed' END AS reason FROM (SELECT user_id, max(ts) AS ts FROM {events} GROUP BY 1) n LEFT JOIN (SELECT user_id, max(ts) AS last FROM {events} WHERE ts < TIMESTAMP '2024-01-15 00:00:00' AND user_id % 5 <> 0 GROUP BY 1) s USING (user_id)
WHERE s.last IS NULL OR (n.ts >= TIMESTAMP '2024-01-14 23:58:00' AND n.ts <> s.last)""")
def _(t):
    now = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    before = t.events.filter("ts < timestamp_ntz '2024-01-15 00:00:00' and user_id % 5 <> 0").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return incremental.changed_since(now, before, "user_id", "ts", datetime(2024, 1, 15)).select("user_id", "reason")


@query("X02_forget_unseen", "SELECT user_id, event_type FROM (SELECT user_id, event_type, max(ts) AS seen FROM {events} GROUP BY 1, 2) WHERE seen >= (TIMESTAMP '2024-02-01 00:00:00' - INTERVAL '3' DAY)")
def _(t):
    seen = t.events.groupBy("user_id", "event_type").agg(F.max("ts").alias("seen"))
    return incremental.forget(seen, "seen", datetime(2024, 2, 1), 3).select("user_id", "event_type")


@query("U04_dropped_ids", "SELECT DISTINCT o_custkey FROM {orders} WHERE o_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00')")
def _(t):
    now = t.orders.filter("o_orderdate >= timestamp_ntz '2000-01-01 00:00:00'").select("o_custkey").distinct()
    return incremental.dropped(now, t.orders.select("o_custkey").distinct(), "o_custkey")


# ── sinks ────────────────────────────────────────────────────────────────────────────────────────────────────


@query("S15_append_findings", "SELECT 1 AS run_id, severity, count(*) AS n FROM {findings} GROUP BY 2 UNION ALL SELECT 2, severity, count(*) FROM {findings} WHERE severity = 'critical' GROUP BY 2")
def _(t):
    path = f"{shared_dir(t.spark)}/sink-{uuid.uuid4().hex}"
    tables.append_run(findings_of(t), 1, path)
    tables.append_run(findings_of(t).filter("severity = 'critical'"), 2, path)
    return t.spark.read.parquet(path).groupBy("run_id", "severity").agg(F.count("*").alias("n"))


@query("S16_profile_upsert", """
SELECT scope, key, metric, coalesce(n.n, o.n) AS n, coalesce(n.mean, o.mean) AS mean, coalesce(o.adj, 0) AS threshold_adj FROM (SELECT scope, key, metric, n, mean FROM {profiles} WHERE n % 2 = 0) n
FULL JOIN (SELECT scope, key, metric, n + 1 AS n, mean * 2 AS mean, 0.3e0 AS adj FROM {profiles} WHERE n % 3 = 0) o USING (scope, key, metric)""", "mean threshold_adj")
def _(t):
    from catalogue.consumption import profiles_of

    fresh = profiles_of(t).filter("n % 2 = 0").select("scope", "key", "metric", "n", "mean")
    stored_rows = profiles_of(t).filter("n % 3 = 0").select("scope", "key", "metric", (F.col("n") + 1).alias("n"), (F.col("mean") * 2).alias("mean"), F.lit(0.3).alias("threshold_adj"))
    return tables.merge_profiles(stored_rows, fresh)


@query("S17_C19_case_json", "SELECT line_id, methods FROM {findings}")
def _(t):
    text = tables.json_columns(findings_of(t).select("line_id", "methods"), "methods")
    return tables.parse_json(text, methods="array<string>").select("line_id", F.array_join("methods", ",").alias("methods"))


@query("S18_consumption_report", """
SELECT 'findings' AS name, count(*) AS rows_written, count(*) AS rows_total, TRUE AS complete FROM {findings} UNION ALL SELECT 'patterns', count(*), count(*), TRUE FROM {patterns} UNION ALL SELECT 'monthly', count(DISTINCT month), count(DISTINCT month), TRUE FROM {enriched}""")
def _(t):
    from stockwarden.operators.history import monthly

    path = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    return tables.write_report({"findings": findings_of(t), "patterns": patterns_of(t), "monthly": monthly(lines_of(t))}, path)


@query("S19_supply_report", """
SELECT 'plan' AS name, count(*) AS rows_written, count(*) AS rows_total, TRUE AS complete FROM {plan} WHERE level = 'local' UNION ALL SELECT 'purchases', count(*), count(*), TRUE FROM {plan} WHERE level = 'network' AND suggested > 0
UNION ALL SELECT 'late', count(*), count(*), TRUE FROM {pending} WHERE late""")
def _(t):
    path = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    plan = wh_plan(t)
    return tables.write_report({"plan": replenish.ordered_plan(plan.filter("level = 'local'")), "purchases": plan.filter("level = 'network' and suggested > 0"), "late": t.pending.filter("late")}, path, "csv")


@query("S18_report_contents", """
SELECT 'findings' AS name, line_id AS key, score AS value FROM {findings} UNION ALL SELECT 'patterns', rule || '|' || key, score FROM {patterns} UNION ALL SELECT 'monthly', month, sum(amount) FROM {enriched} GROUP BY 2""", "value:1")
def _(t):
    from stockwarden.operators.history import monthly

    path = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    tables.write_report({"findings": findings_of(t), "patterns": patterns_of(t), "monthly": monthly(lines_of(t))}, path)
    read = lambda name, key, value: t.spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("name"), F.expr(key).alias("key"), F.expr(value).cast("double").alias("value"))
    return read("findings", "line_id", "score").unionByName(read("patterns", "rule || '|' || key", "score")).unionByName(read("monthly", "month", "amount"))


@query("S19_report_contents", "SELECT level, product_id, location, suggested FROM {plan} WHERE level = 'local' OR suggested > 0", "suggested:3")
def _(t):
    path = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    plan = wh_plan(t)
    tables.write_report({"plan": replenish.ordered_plan(plan.filter("level = 'local'")), "purchases": plan.filter("level = 'network' and suggested > 0")}, path, "csv")
    read = lambda name: t.spark.read.option("header", "true").schema(plan.schema).csv(f"{path}/{name}").select("level", "product_id", "location", "suggested")
    return read("plan").unionByName(read("purchases"))


@query("S20_O09_export_limit", """
SELECT 'lines' AS name, least(count(*), 5000) AS rows_written, count(*) AS rows_total, count(*) <= 5000 AS complete FROM {consumption}""")
def _(t):
    return tables.write_report({"lines": t.consumption}, f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}", max_rows=5000)
