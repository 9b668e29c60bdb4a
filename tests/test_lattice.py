"""Distinct counts from the lattice equal those counted one by one."""

import random
from datetime import datetime, timedelta

import pytest

from stockwarden.operators import adhoc, history, lattice

LINES = "case_no string, hospital string, product_id bigint, product string, unit string, weighable boolean, ts timestamp_ntz, qty double, amount double"


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(8)
    rows = [(f"C{rng.randrange(90)}", rng.choice(["N", "S", "E", ""]), p := rng.randrange(5), f"item {p}", rng.choice(["mL", "pc"]), False,
             datetime(2026, 7, 31) - timedelta(hours=rng.randrange(2400)), float(rng.randrange(1, 9)), float(rng.randrange(100))) for _ in range(900)]
    rows += [("HOT", "N", 1, "item 1", "mL", False, datetime(2026, 7, 1) + timedelta(minutes=k % 900), 1.0, 2.0) for k in range(3000)]
    rows += [(None, "N", 2, "item 2", "pc", False, datetime(2026, 7, 5), 1.0, 1.0), (None, "S", 2, "item 2", "pc", False, datetime(2026, 5, 5), 1.0, 1.0)]
    return spark.createDataFrame(rows, LINES)


def as_set(df, *columns):
    return {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()}


def test_levels_equal_plain_distinct_counts(lines):
    made = lattice.case_lattice(lines)
    columns = ("hospital", "month", "qty", "amount", "cases", "lines")
    assert as_set(lattice.rolled_up(made, "hospital_month"), *columns) == as_set(adhoc.group_lines(lines, ["hospital", "month"]), *columns)
    columns = ("month", "amount", "cases", "lines", "volatile_ml")
    assert as_set(lattice.monthly_cases(made), *columns) == as_set(history.monthly(lines), *columns)
    columns = ("hospital", "amount", "amount_prev", "cases", "cases_prev", "change_pct", "amount_per_case", "amount_per_case_prev")
    assert as_set(lattice.compared_hospitals(made), *columns) == as_set(history.hospital_comparison(lines), *columns)
    columns = ("lines", "cases", "products", "hospitals", "qty", "amount")
    assert as_set(lattice.whole_overview(made, lines), *columns) == as_set(adhoc.overview(lines), *columns)


def test_no_lines(lines):
    made = lattice.case_lattice(lines.limit(0))
    assert lattice.rolled_up(made, "month").count() == 0
    assert lattice.rolled_up(made, "all").first()["cases"] == 0


def test_numbers_follow_the_order(spark):
    names = [f"n{k:05d}" for k in range(3000)]
    rows = spark.createDataFrame([(n,) for n in random.Random(2).sample(names, len(names))], "name string").repartition(7)
    got = {r["name"]: r["at"] for r in adhoc.numbered(rows, "name", "at").collect()}
    assert got == {n: k for k, n in enumerate(names, 1)}
    assert adhoc.numbered(rows.limit(0), "name", "at").count() == 0
