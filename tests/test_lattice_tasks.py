"""The roll-up by case holds a bounded number of rows in a task."""

from datetime import datetime

from stockwarden.operators import lattice


def test_levels_share_sorts_and_tasks_grow_with_their_rows(spark, monkeypatch):
    rows = [(datetime(2001, 1 + i % 6, 1 + i % 28), f"C{i // 3}", ["North", "South"][i % 2], "agent", "pc", 1.0, 2.0, False) for i in range(200)]
    lines = spark.createDataFrame(rows, "ts timestamp_ntz, case_no string, hospital string, product string, unit string, qty double, amount double, weighable boolean")
    made = lattice.case_lattice(lines)
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 3
    few = made.rdd.getNumPartitions()
    monkeypatch.setattr(lattice, "TASK_ROWS", 5)
    assert lattice.case_lattice(lines).rdd.getNumPartitions() > few
