from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.operators import evidence, scenario
from stockwarden.operators.rebalance import coverage_after

CFG = SupplyConfig(as_of=date(2026, 8, 1), horizon=10)


def test_hypotheses_follow_the_evidence(spark):
    rows = spark.createDataFrame(
        [("f1", ["R03_SCALE_MISMATCH"], False, True, True, True, False), ("f2", ["R07_TRAVELLING_LOT", "R09_EXPIRED_LOT"], True, False, False, False, True), ("f3", ["z_doctor", "z_product"], False, False, True, True, False)],
        "fingerprint string, methods array<string>, scale_ok boolean, scale_off boolean, no_doctor boolean, odd_day boolean, foreign_lot boolean")
    got = evidence.rank_hypotheses(rows).collect()
    first = {r["fingerprint"]: r for r in got if r["rank"] == 1}
    assert first["f1"]["hypothesis"] == evidence.CAUSES["loss"][0] and first["f1"]["in_favour"] == 1 and first["f1"]["plausibility"] == "high"
    assert first["f2"]["hypothesis"] == evidence.CAUSES["move"][0] and first["f2"]["plausibility"] == "high"
    entry = [r for r in got if r["fingerprint"] == "f2" and r["hypothesis"] == evidence.CAUSES["capture"][0]]
    assert len(entry) == 1 and entry[0]["plausibility"] == "low"
    assert first["f3"]["hypothesis"] == evidence.CAUSES["surgery"][0]
    assert sum(r["fingerprint"] == "f3" for r in got) == 3


def test_an_installation_brings_its_own_hypotheses(spark):
    rows = spark.createDataFrame([("f", ["R01_OVER_CONTAINER"], False, True, False, False, False)],
                                 "fingerprint string, methods array<string>, scale_ok boolean, scale_off boolean, no_doctor boolean, odd_day boolean, foreign_lot boolean")
    own = spark.createDataFrame([(0, "R01_OVER_CONTAINER", "first", "a", ""), (1, "R01_OVER_CONTAINER", "second", "b", "capture,loss")], "position int, rule string, hypothesis string, check string, about string")
    got = sorted((r["rank"], r["hypothesis"], r["in_favour"]) for r in evidence.rank_hypotheses(rows, own).collect())
    assert got == [(1, "second", 2), (2, "first", 0)]


def test_targets_outlast_forty_investigations(spark):
    finding = "fingerprint string, methods array<string>, case_no string, product_id bigint, product string, hospital string, technician string, doctor string, lot string, sublocation string, ts timestamp_ntz, qty double, severity string, risk_amount double, line_id string"
    found = spark.createDataFrame([(f"f{k}", ["R01_OVER_CONTAINER"], f"C{k}", 1, "p", "h", "t", "d", "l", "s", datetime(2026, 7, 1), 1.0, "high", 1000.0 - k, str(k)) for k in range(200)], finding)
    pattern = "rule string, product_id bigint, key string, dimension string, product string, hospital string, actor string, severity string, risk_amount double, score double"
    known = spark.createDataFrame([(f"f{k}",) for k in range(40)], "fingerprint string")
    none = spark.createDataFrame([], pattern)
    assert evidence.targets(found, none, known).count() == 160
    assert sorted(r["fingerprint"] for r in evidence.targets(found, none, known, 8).collect()) == sorted(f"f{k}" for k in range(40, 48))


def test_no_origin_gives_more_than_it_has(spark):
    plan = spark.createDataFrame(
        [("network", 1, "p", "ALL", "reorder", 200.0, 3, False, date(2026, 8, 4), date(2026, 8, 9), None)]
        + [("local", 1, "p", place, "critical", need, day, True, None, None, date(2026, 8, 2)) for place, need, day in (("A", 80.0, 1), ("B", 90.0, 2), ("X", 10.0, 3))],
        "level string, product_id bigint, product string, location string, criticality string, suggested double, stockout_day int, in_time boolean, stockout_date date, arrival_date date, need_date date")
    free = spark.createDataFrame([(1, "C", "excess", 100.0), (1, "D", "ok", 60.0)], "product_id bigint, location string, criticality string, free double")
    got = sorted((r["origin"], r["destination"], r["qty"]) for r in scenario.preventive_transfers(plan, free).collect())
    assert got == [("C", "A", 80.0), ("C", "B", 20.0), ("D", "B", 60.0)]


TARGET = "fingerprint string, kind string, methods array<string>, dimension string, key string, case_no string, product_id bigint, product string, hospital string, technician string, doctor string, lot string, sublocation string, ts timestamp_ntz, severity string"


def test_confidence_needs_four_pieces(spark):
    targets = spark.createDataFrame([("f1", "finding", ["R03_SCALE_MISMATCH"], None, None, "C1", 1, "agent", "N", "T1", "D1", "L1", "N/OR", datetime(2026, 7, 1, 9), "high"),
                                     ("p1", "pattern", ["R10_LEVEL_SHIFT"], "sublocation", "N/OR", None, 1, "agent", "N", None, None, None, "N/OR", None, "high")], TARGET)
    readings = spark.createDataFrame([("C1", "agent")], "case_no string, product string")
    history = spark.createDataFrame([("T1", "agent", 0.3, 0.2)], "name string, product string, rate_median double, peer_rate double")
    lots = spark.createDataFrame([("L1",)], "lot string")
    days = spark.createDataFrame([("N", date(2026, 7, 1))], "hospital string, day date")
    mismatch = spark.createDataFrame([("T1",)], "technician string")
    periods = spark.createDataFrame([("sublocation", "N/OR", "agent", True)], "dimension string, key string, product string, history_insufficient boolean")
    got = {r["fingerprint"]: r for r in evidence.evidence_confidence(targets, readings, history, lots, days, mismatch, periods).collect()}
    assert got["f1"]["evidence"] == 7 and got["f1"]["confidence"] == "medium"
    assert got["p1"]["evidence"] == 1 and got["p1"]["confidence"] == "low"


def plain_coverage(opening, demand, events):
    balance = opening + sum(q for t, q in events if t <= 0)
    if balance < -1e-9:
        return 0.0
    for day, used in enumerate(demand, 1):
        after = balance + sum(q for t, q in events if t == day) - used
        if after < -1e-9:
            return max(0.0, round(day - 1 + (balance / used if used > 0 else 0.0), 2))
        balance = after
    return float(len(demand))


def test_coverage_after_a_transfer(spark):
    demand = {"A": [4.0] * 10, "B": [1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 1.0], "C": [2.0] * 10}
    opening = {"A": 6.0, "B": 30.0, "C": 5.0}
    events = {"A": [(5, 7.0)], "B": [(3, -4.0)], "C": []}
    moves = [("B", "A", 9.0), ("B", "C", 6.0)]
    transfers = spark.createDataFrame([(1, o, d, q) for o, d, q in moves], "product_id bigint, origin string, destination string, qty double")
    openings = spark.createDataFrame([(1, k, v, 0.0) for k, v in opening.items()], "product_id bigint, location string, opening double, safety double")
    steps = spark.createDataFrame([(1, k, i + 1, x) for k, v in demand.items() for i, x in enumerate(v)], "product_id bigint, location string, step int, qty double")
    flow = spark.createDataFrame([(1, k, t, q) for k, v in events.items() for t, q in v], "product_id bigint, location string, t int, qty double")
    got = {r["destination"]: r for r in coverage_after(transfers, openings, steps, flow, CFG).collect()}
    for origin, destination, qty in moves:
        assert got[destination]["coverage_after"] == plain_coverage(opening[destination], demand[destination], [*events[destination], (2, qty)])
        assert got[destination]["origin_coverage_after"] == plain_coverage(opening[origin], demand[origin], [*events[origin], (2, -qty)])


@pytest.fixture(scope="module")
def small_plan(spark):
    local = spark.createDataFrame([(1, "N/OR", "agent", "N", "mL", "local", 100.0, 10.0, 2.0, 20.0, False), (1, "S/OR", "agent", "S", "mL", "local", 100.0, 5.0, 2.0, 10.0, False)],
                                  "product_id bigint, location string, product string, hospital string, unit string, level string, stock double, daily_demand double, lead_time double, safety_stock double, is_dc boolean")
    rows = spark.createDataFrame([(1, p, s, d) for p, d in (("N/OR", 10.0), ("S/OR", 5.0)) for s in range(1, 11)], "product_id bigint, location string, step int, projected double")
    events = spark.createDataFrame([(1, "N/OR", 4, "PO1", "purchase", "ACME", 30.0)], "product_id bigint, location string, t int, ref string, kind string, supplier string, qty double")
    return local, rows, events


def test_unchanged_scenario_worsens_nothing(small_plan):
    assert scenario.simulate(*small_plan, scenario.Scenario("same"), CFG).count() == 0


def test_demand_and_delay(small_plan):
    local, rows, events = small_plan
    surge = scenario.simulate(local, rows, events, scenario.Scenario("surge", {"n/or": 2.0}), CFG).collect()
    assert [r["location"] for r in surge] == ["N/OR"] and surge[0]["base_stockout"] is None and surge[0]["new_stockout"] == 7
    assert surge[0]["residual_shortfall"] == pytest.approx(90.0)
    lost = scenario.simulate(local, rows, events, scenario.Scenario("lost", drop_in_transit=True), CFG)
    assert lost.count() == 0 or lost.filter(F.col("location") != "N/OR").count() == 0
    more = events.unionByName(events)
    assert scenario.simulate(local, rows, more, scenario.Scenario("late", {"n/or": 1.6}, {"po1": 30}), CFG).count() == 1


def test_clarifications_of_repeated_targets_and_notes_appear_once(spark):
    names = "technician string, doctor string, product string, hospital string, lot string"
    targets = [("a", "T1", "D1", "p", "H1", ""), ("a", "T2", "D2", "p", "H2", ""), ("b", "T1", "D1", "p", "H1", ""), ("b", "T1", "D1", "p", "H1", ""), ("c", "T1", "D2", "q", "H2", "x"), ("d", None, "D1", None, None, None), (None, "T2", "", "", "H1", "")]
    notes = [(1, "actor", "T1", "D2", "", "", ""), (2, "actor", "T1", "D1", "", "", ""), (3, "hospital", "", "", "", "H1", ""), (3, "actor", "T2", "", "", "", ""), (3, "actor", "T2", "", "", "", ""),
             (4, "product_hospital", "", "", "p", "H2", ""), (5, "hospital", None, None, None, None, None), (6, "case", "T1", "D1", "p", "H1", ""), (None, "hospital", "", "", "", "H2", ""), (7, "actor", None, "D2", None, None, None)]
    t, n = spark.createDataFrame(targets, "fingerprint string, " + names), spark.createDataFrame(notes, "note_id long, scope string, " + names)
    need = set()
    for f, tech, doc, product, hospital, _ in targets:
        for note, scope, *own in notes:
            actor = (own[0] and own[0] == tech) or (own[1] and own[1] == doc)
            here = own[3] and own[3] == hospital
            if (scope == "actor" and actor) or (scope == "hospital" and here) or (scope == "product_hospital" and here and own[2] and own[2] == product):
                need.add((f, note))
    got = [tuple(r) for r in evidence.applicable_clarifications(t, n).collect()]
    assert len(got) == len(set(got)) and set(got) == need and len(need) > 10
    assert evidence.applicable_clarifications(t, n, 1).count() == len({f for f, _ in need})


def test_clarifications_are_not_shuffled_as_pairs(spark):
    """Pairs leave the join as they are; the only rows that are made distinct are those of repeated keys, here none."""
    names = "technician string, doctor string, product string, hospital string, lot string"
    t = spark.createDataFrame([(f"f{k}", "", "", "", "H", "") for k in range(300)], "fingerprint string, " + names)
    n = spark.createDataFrame([(k, "hospital", "", "", "", "H", "") for k in range(200)], "note_id long, scope string, " + names)
    rows = evidence.applicable_clarifications(t, n)
    assert rows.count() == 60_000
    assert rows._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
