"""Registered queries against their SQL on the smallest data folder, and the shape of key plans."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "A02_group_by_hospital_month", "S07_usable_stock", "J01_line_header_join", "A01_profiles", "R_FUSE_findings", "R10_W03_level_shifts", "F12_backtest_choice", "F18_P19_local_replenishment",
    "F21_W06_J13_expiry_risk", "A26_J18_commitments_ledger", "J24_recheck", "D12_feedback_thresholds", "X01_incremental_snapshot",
    "A12_U03_C16_risk_index", "A10_hospital_comparison", "F22_J15_O08_rebalancing", "F24_coverage_after_transfer", "F28_J27_material_changes", "D08_J21_similar_cases", "D10_hypotheses", "X04_alert_once",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, DuckDB now and then fails inside on tables this small
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_window_filter_reaches_the_scan(spark):
    text = plan_of(entry.queries()["O04_finding_listing"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(severity), EqualTo(severity,high)]" in text
    assert "ReadSchema: struct<line_id:string,score:double,severity:string>" in text


def test_no_query_pairs_everything(spark):
    for name in ("R11_J10_actor_deviations", "R_FUSE_findings", "F23_operating_reserve"):
        assert "CartesianProduct" not in plan_of(entry.queries()[name](spark, FOLDER))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
