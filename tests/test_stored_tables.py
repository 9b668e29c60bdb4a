"""What is written on the way takes little disk: no second shuffle of lines, no shuffle files left behind, no column that follows from others."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from catalogue import consumption, views
from stockwarden.session import materialize


def _tables(spark, tmp_path):
    spark.sql("select 0 r_regionkey, 'R' r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.sql("select id n_nationkey, concat('N', id) n_name, 0 n_regionkey from range(4)").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select id c_custkey, concat('C', id) c_name, id % 4 c_nationkey, 'M' c_mktsegment from range(20) union all select 3, 'again', 1, 'M'").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select id s_suppkey, concat('S', id) s_name, id % 4 s_nationkey from range(9)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("select id * 100 o_orderkey, nullif(id % 21, 20) o_custkey, 'O' o_orderstatus, timestamp_ntz '2001-01-01 00:00:00' o_orderdate, 5D o_totalprice from range(60)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("""select id % 60 * 100 l_orderkey, id % 23 l_partkey, nullif(id % 10, 9) l_suppkey, cast(id % 7 as int) + 1 l_linenumber, cast(id % 12 as double) l_quantity, id * 1.5D l_extendedprice, 0.1D l_discount,
                 timestamp_ntz '2001-01-01 00:00:00' + make_dt_interval(cast(id % 90 as int)) l_shipdate, 'A' l_returnflag, 'F' l_linestatus from range(500)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    return views.Tables(spark, str(tmp_path))


def test_facts_are_the_rows_of_their_view(spark, tmp_path):
    t = _tables(spark, tmp_path)
    facts, view = t.facts, t._view(views.VIEWS["facts"])
    assert facts.schema == view.schema and facts.count() > 300
    assert facts.exceptAll(view).count() == 0 and view.exceptAll(facts).count() == 0


def test_lines_are_stored_without_another_shuffle_or_the_cost_of_a_unit(spark, tmp_path, monkeypatch):
    t, seen = _tables(spark, tmp_path), {}

    def write(spark, folder, name, build):
        seen[name] = build()
        return seen[name]

    monkeypatch.setattr(consumption, "stored", write)
    lines = consumption.lines_of(t)
    stored = seen["feature-lines"]
    assert "unit_cost" not in stored.columns and "REPARTITION" not in stored._jdf.queryExecution().executedPlan().toString()
    assert lines.filter("qty > 0 and unit_cost <> amount / qty or qty <= 0 and unit_cost <> 0").count() == 0


def test_shuffle_files_of_a_write_go_with_a_later_one(spark):
    folder = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0])
    rows = spark.range(100_000).groupBy((F.col("id") % 50_021).alias("k")).agg(F.sum("id").alias("s"))
    before = {p.name for p in folder.rglob("shuffle_*.data")}
    materialize(rows, "summed")
    for _ in range(8):
        materialize(spark.range(1), "next")
        if not {p.name for p in folder.rglob("shuffle_*.data")} - before:
            return
        time.sleep(0.25)
    raise AssertionError("shuffle files are left")
