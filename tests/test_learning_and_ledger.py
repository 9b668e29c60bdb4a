from datetime import date, datetime, timedelta

import pytest

from stockwarden.config import Policy
from stockwarden.operators import learning, ledger

FEEDBACK = "event_id bigint, labelled_at timestamp_ntz, finding_id bigint, status string, product_id bigint, hospital string, doctor string"


def shifts(spark, labels):
    start = datetime(2026, 1, 1)
    rows = [(i, start + timedelta(hours=7 * i), f, s, 1, "NORTH", "D") for i, (f, s) in enumerate(labels)]
    got = learning.threshold_shifts(learning.label_changes(spark.createDataFrame(rows, FEEDBACK)))
    return {(r["scope"], r["metric"]): r["threshold_adj"] for r in got.collect()}


def test_justify_repeat_confirm(spark):
    assert shifts(spark, [(1, "justified")])[("product", "qty")] == pytest.approx(0.15)
    assert shifts(spark, [(1, "justified"), (1, "justified")])[("product", "rate")] == pytest.approx(0.15)
    assert shifts(spark, [(1, "justified"), (1, "confirmed")])[("product_hospital", "qty")] == pytest.approx(-0.15)


def test_clip_depends_on_the_path(spark):
    up = [(i, "justified") for i in range(30)]
    down = [(100 + i, "confirmed") for i in range(4)]
    assert shifts(spark, up)[("product", "qty")] == pytest.approx(1.5)
    assert shifts(spark, up + down)[("product", "qty")] == pytest.approx(0.9)


PROPOSAL = ("id bigint, kind string, status string, product_id bigint, product string, qty double, unit string, origin string, destination string, location string, lot string, amount double, criticality string, "
            "needed_on date, in_time boolean, covered_before double, origin_short boolean, doc_state string, doc_ref string, doc_kind string, created_at timestamp_ntz, risk string, last_run bigint, title string")


def proposal(i, kind="transfer", status="proposed", qty=10.0, amount=100.0, origin="DC", destination="A", created=datetime(2026, 7, 30), **other):
    row = dict(id=i, kind=kind, status=status, product_id=1, product="item", qty=qty, unit="pc", origin=origin, destination=destination, location=None, lot=None, amount=amount, criticality="critical",
               needed_on=date(2026, 8, 3), in_time=True, covered_before=0.0, origin_short=False, doc_state=None, doc_ref=None, doc_kind=kind, created_at=created, risk="low", last_run=1, title=f"p{i}")
    return tuple({**row, **other}[c.split()[0]] for c in PROPOSAL.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), PROPOSAL)


def test_policy_caps_block(spark):
    rows = frame(spark, proposal(1), proposal(2, qty=6000.0), proposal(3, amount=200000.0), proposal(4, kind="nonsense"), proposal(5, kind="alert", amount=60000.0))
    got = {r["id"]: (r["allowed"], r["risk"]) for r in ledger.evaluate(rows, Policy()).collect()}
    assert got[1] == (True, "low") and not got[2][0] and not got[3][0] and not got[4][0] and got[5] == (True, "low")


def test_firm_commitments_only_count_decided(spark):
    rows = frame(spark, proposal(1), proposal(2, status="approved", qty=7.0), proposal(3, status="rejected"), proposal(4, status="executed", qty=3.0, doc_state="done", doc_ref="X"))
    planning = ledger.commitments(ledger.active(rows))["origin"].first()["qty"]
    firm = ledger.commitments(ledger.active(rows, firm=True))["origin"].first()["qty"]
    assert planning == 17.0 and firm == 7.0


def test_recheck(spark):
    rows = frame(spark, proposal(1, qty=100.0), proposal(2, created=datetime(2026, 7, 1)), proposal(3, qty=5.0), proposal(4, kind="purchase", origin=None, destination=None))
    stock = spark.createDataFrame([(1, "DC", "L", 60.0, 10.0)], "product_id bigint, location string, lot string, qty double, reserved double")
    bought = spark.createDataFrame([(1, datetime(2026, 7, 28))], "product_id bigint, created_at timestamp_ntz")
    got = {r["id"]: r for r in ledger.recheck(rows, stock, bought, Policy(), datetime(2026, 8, 1)).collect()}
    assert got[1]["verdict"] == "needs_review" and got[1]["qty"] == 50.0
    assert got[2]["verdict"] == "expired" and got[3]["verdict"] == "ok" and got[4]["verdict"] == "needs_review"


def test_material_change_and_superseded(spark):
    stored = frame(spark, proposal(1, qty=10.0), proposal(2, qty=10.0), proposal(3, destination="B"))
    new = ledger.with_key(frame(spark, proposal(9, qty=10.1), proposal(8, destination="C")))
    got = {r["key"].split("destination=")[1]: r["change"] for r in ledger.changes(new, stored, Policy()).collect()}
    assert got == {"A": "unchanged", "C": "new", "B": "absent"}
    assert [(r["id"], r["kept_id"]) for r in ledger.superseded(stored).collect()] == [(1, 2)]


def test_location_names(spark):
    places = spark.createDataFrame([(1, "WH/Stock"), (2, "North/OR"), (3, "OR")], "location_id bigint, name string")
    names = spark.createDataFrame([("WH/Stock",), ("or",), ("NORTH/or",), ("nowhere",)], "name string")
    assert {r["name"]: r["location_id"] for r in ledger.resolve_locations(names, places).collect()} == {"WH/Stock": 1, "or": 3, "NORTH/or": 2}
