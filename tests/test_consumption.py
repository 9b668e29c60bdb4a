"""Rules, findings and patterns on lines with planted irregularities."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwarden.config import RULES_NEEDING_CASES, ConsumptionConfig
from stockwarden.plans.consumption_run import run_consumption
from stockwarden.schema import CONSUMPTION

END = datetime(2026, 6, 30, 12)


def line(i, ts, qty=24.0, case=None, hospital="NORTH", doctor="D1", technician="T1", lot="LN", minutes=100.0, start=300.0, end=None, measured=None, expiry=datetime(2030, 1, 1)):
    end = start - qty if end is None else end
    return (f"L{i:06d}", ts, ts.date(), i, case or f"C{i}", hospital, doctor, technician, f"{hospital}/OR", hospital, 1, "sevoflurane 250 mL", lot, expiry, float(qty), "mL", float(qty) * 10, False,
            start, end, measured, True, minutes, "clinical")


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for day in range(200):
        ts = END - timedelta(days=day)
        if ts.weekday() >= 5:
            continue
        for hospital, lot in (("NORTH", "LN"), ("SOUTH", "LS")):
            for k in range(3):
                i += 1
                factor = 1.45 if (k == 2 and hospital == "NORTH" and day < 28) else 1.0
                minutes = float(rng.integers(90, 120))
                rows.append(line(i, ts + timedelta(minutes=k), round(0.24 * minutes * factor + float(rng.normal(0, 0.4)), 1), hospital=hospital, technician=f"T{hospital}{k}", lot=lot, minutes=minutes))
    week = END - timedelta(days=5)
    plants = {
        "R01_OVER_CONTAINER": line(900001, week, 300.0, start=700.0), "R02_SCALE_IMPOSSIBLE": line(900002, week, 24.0, start=300.0, end=330.0),
        "R03_SCALE_MISMATCH": line(900003, week, 24.0, start=300.0, end=250.0), "R04_NO_SURGERY": line(900004, week, 20.0, doctor="", minutes=None),
        "R05_ODD_HOURS": line(900005, week.replace(hour=23), 20.0, doctor="", minutes=None), "R06_CLINICAL_RATE": line(900006, week, 60.0, minutes=20.0),
        "R07_TRAVELLING_LOT": line(900007, week, 24.0, hospital="SOUTH", lot="LN"), "R08_DUPLICATE": line(900009, week, 24.0, case="CX"), "R09_EXPIRED_LOT": line(900010, week, 24.0, expiry=datetime(2026, 1, 1)),
    }
    rows += list(plants.values()) + [line(900008, week, 24.0, case="CX")]
    return spark.createDataFrame(rows, CONSUMPTION).cache(), {m: r[0] for m, r in plants.items()}


@pytest.fixture(scope="module")
def run(lines):
    return run_consumption(lines[0], ConsumptionConfig(trees=60))


def test_every_plant_is_found(run, lines):
    found = {r["line_id"]: set(r["methods"]) for r in run["findings"].collect()}
    for method, line_id in lines[1].items():
        assert method in found.get(line_id, set()), method


def test_noise_is_low(run, lines):
    planted = set(lines[1].values())
    clean = run["findings"].filter(~F.col("line_id").isin(*planted)).count()
    assert clean < 0.05 * lines[0].count()


def test_first_copy_is_not_a_duplicate(run):
    first = run["findings"].filter("line_id = 'L900008'").collect()
    assert all("R08_DUPLICATE" not in r["methods"] for r in first)


def test_expectation_and_money(run):
    row = run["findings"].filter("line_id = 'L900004'").first()
    assert row["expected"] == 0.0 and row["risk_amount"] == pytest.approx(200.0)
    assert row["severity"] == "critical"


def test_over_consuming_technician_is_a_pattern(run):
    actors = run["patterns"].filter("rule = 'R11_ACTOR_DEVIATION' and dimension = 'technician'").collect()
    assert [a["actor"] for a in actors] == ["TNORTH2"]
    assert actors[0]["ratio"] == pytest.approx(1.45, abs=0.06)
    top = run["risk"].filter("dimension = 'technician'").orderBy("rank").limit(3).collect()
    assert "TNORTH2" in [r["key"] for r in top]


def test_history(run):
    assert run["monthly"].count() >= 6
    assert run["seasonality"].filter("kind = 'weekday'").count() == 5 or run["seasonality"].filter("kind = 'weekday'").count() == 7


def test_degraded_mode_switches_rules_off(lines):
    off = run_consumption(lines[0], ConsumptionConfig(disabled_rules=RULES_NEEDING_CASES), with_forest=False)
    used = {m for r in off["findings"].select("methods").collect() for m in r["methods"]}
    assert not used & set(RULES_NEEDING_CASES) and "R01_OVER_CONTAINER" in used


def test_justified_fingerprint_disappears(lines, run):
    mark = run["findings"].filter("line_id = 'L900001'").select("fingerprint")
    again = run_consumption(lines[0], ConsumptionConfig(), justified=mark, with_forest=False)
    assert again["findings"].filter("line_id = 'L900001'").count() == 0


def test_forest_is_repeatable_and_flags_the_odd_line(spark, lines):
    from stockwarden.operators.features import line_features
    from stockwarden.operators.forest import forest_scores

    feature_lines = line_features(lines[0])
    cfg = ConsumptionConfig(trees=80)
    first = {r["line_id"]: r["score"] for r in forest_scores(feature_lines, cfg).collect()}
    second = {r["line_id"]: r["score"] for r in forest_scores(feature_lines.repartition(5), cfg).collect()}
    assert first == pytest.approx(second)
    ranked = sorted(first, key=first.get, reverse=True)
    assert {"L900005", "L900001", "L900006"} & set(ranked[:5])
    assert all(0 < s < 1 for s in first.values())
