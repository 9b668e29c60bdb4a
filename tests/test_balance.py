"""Balance projection against hand-computed numbers."""

import pytest

from stockwarden.operators.balance import project

CASES = {
    # name: opening, events (day, qty), safety -> expected columns
    "early_receipt": (10, [(1, 300)], 20, {"stockout_day": None, "coverage": 30.0}),
    "late_receipt": (10, [(25, 300)], 20, {"stockout_day": 2, "coverage": 1.0, "need_day": 1}),
    "beyond_horizon": (300, [(35, 100)], 0, {"closing": 0.0, "events_beyond": 1}),
    "last_day": (300, [(30, 100)], 0, {"closing": 100.0, "events_beyond": 0}),
    "out_beyond": (300, [(31, -100)], 0, {"closing": 0.0}),
    "fraction": (25, [], 0, {"coverage": 2.5, "stockout_day": 3, "need_day": 2}),
    "overdue_today": (5, [(-3, 20)], 0, {"stockout_day": 3, "coverage": 2.5}),
}


@pytest.fixture(scope="module")
def result(spark):
    openings = spark.createDataFrame([(k, float(v[0]), float(v[2]), 30) for k, v in CASES.items()], "k string, opening double, safety double, window int")
    demand = spark.createDataFrame([(k, s, 10.0) for k in CASES for s in range(1, 31)], "k string, step int, qty double")
    events = spark.createDataFrame([(k, d, float(q)) for k, v in CASES.items() for d, q in v[1]], "k string, t int, qty double")
    return {r["k"]: r for r in project(openings, demand, events, ["k"], 30).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(result, name):
    for column, value in CASES[name][3].items():
        assert result[name][column] == value, column


def test_shortfall_of_late_receipt(result):
    assert result["late_receipt"]["shortfall"] >= 250


def test_no_demand_has_no_coverage(spark):
    openings = spark.createDataFrame([("x", 5.0, 0.0, 3)], "k string, opening double, safety double, window int")
    none = spark.createDataFrame([], "k string, step int, qty double")
    events = spark.createDataFrame([], "k string, t int, qty double")
    row = project(openings, none, events, ["k"], 3).first()
    assert row["coverage"] is None and row["closing"] == 5.0
