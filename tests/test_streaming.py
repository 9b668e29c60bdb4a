import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockwarden.streaming import incremental, surveillance, versioned

ROWS = "id bigint, written timestamp_ntz, payload string"


def versions(n, start=0):
    base = datetime(2026, 1, 1)
    return [(i % 17, base + timedelta(minutes=start + i), f"v{start + i}") for i in range(n)]


def state_of(spark, path):
    return sorted(map(tuple, versioned.snapshot(spark, path).collect()))


def test_incremental_equals_full(spark, tmp_path):
    source, state, check = (str(tmp_path / x) for x in ("source", "state", "check"))
    schema = spark.createDataFrame([], ROWS).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        incremental.start_snapshot(stream, state, check, "id", ["written", "payload"], rows_per_bucket=5).awaitTermination()

    def full():
        return {r["id"]: r["payload"] for r in versioned.newest(spark.read.parquet(source), "id", ["written", "payload"]).collect()}

    for part in (versions(40), versions(25, 100), [(99, datetime(2026, 3, 1), "late arrival"), (3, datetime(2025, 1, 1), "older version")]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        run()
        assert {r["id"]: r["payload"] for r in versioned.snapshot(spark, state).collect()} == full()
    assert len(versioned.load(spark, state).buckets) >= 4


def test_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    batch = spark.createDataFrame(versions(30), ROWS)
    versioned.merge(batch, path, "id", ["written", "payload"], source="s", batch_id=0)
    before = state_of(spark, path)
    assert versioned.merge(batch, path, "id", ["written", "payload"], source="s", batch_id=0).number == 1
    assert versioned.merge(batch, path, "id", ["written", "payload"]).number == 2
    assert state_of(spark, path) == before


def keyed(spark, ids, payload="p", day=1):
    return spark.createDataFrame([(i, datetime(2026, 1, day), payload) for i in ids], ROWS)


def test_buckets_split_and_only_touched_ones_are_written(spark, tmp_path):
    path = str(tmp_path / "state")
    order = ["written", "payload"]
    versioned.merge(keyed(spark, range(1000)), path, "id", order, rows_per_bucket=50)
    first = versioned.load(spark, path)
    assert len(first.buckets) == 20 and first.rows == 1000
    assert max(n for _, n in first.buckets) < 200
    versioned.merge(keyed(spark, [5], "changed", 2), path, "id", order, rows_per_bucket=51)
    second = versioned.load(spark, path)
    assert sum(a != b for a, b in zip(first.buckets, second.buckets)) == 1 and second.rows == 1000
    versioned.merge(keyed(spark, range(1000, 1300)), path, "id", order, rows_per_bucket=50)
    third = versioned.load(spark, path)
    assert len(third.buckets) == 26 and third.rows == 1300
    got = {r["id"]: r["payload"] for r in versioned.snapshot(spark, path).collect()}
    assert got == {i: "changed" if i == 5 else "p" for i in range(1300)}
    assert versioned.snapshot(spark, path, 1).count() == 1000  # old versions stay readable
    for n in (1, 2, 3, 20, 26, 64):
        held = keyed(spark, range(500)).select(versioned.bucket_of("id", n).alias("b"), versioned.bucket_of("id", n + 7).alias("later")).collect()
        assert all(0 <= r["b"] < n and versioned.ancestor(r["later"], n) == r["b"] for r in held)


def test_merge_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    versioned.merge(keyed(spark, range(100)), path, "id", ["written", "payload"], 30)
    before = state_of(spark, path)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versioned, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        versioned.merge(keyed(spark, range(50, 200), "new", 2), path, "id", ["written", "payload"], 30)
    monkeypatch.undo()
    assert state_of(spark, path) == before and versioned.versions(spark, path) == [1]
    versioned.merge(keyed(spark, range(50, 200), "new", 2), path, "id", ["written", "payload"], 30)
    assert {r[0]: r[2] for r in state_of(spark, path)} == {i: "new" if i >= 50 else "p" for i in range(200)}


def test_of_two_merges_at_once_one_fails(spark, tmp_path):
    path = str(tmp_path / "state")
    old = versioned.merge(keyed(spark, range(10)), path, "id", ["written", "payload"])
    versioned.merge(keyed(spark, [3], "x", 2), path, "id", ["written", "payload"])
    old.number += 1
    with pytest.raises(versioned.Conflict):
        versioned.publish(spark, path, old)
    assert versioned.load(spark, path).number == 2
    assert all(n.suffix != "" for n in (tmp_path / "state" / "_versions").iterdir() if not n.name.startswith("."))


def test_a_key_with_most_rows_of_a_batch(spark, tmp_path):
    path = str(tmp_path / "state")
    versioned.merge(keyed(spark, range(60)), path, "id", ["written", "payload"], 20)
    batch = spark.range(20_000).select(F.lit(7).cast("bigint").alias("id"), F.expr("timestamp_ntz '2026-02-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("written"), F.col("id").cast("string").alias("payload"))
    versioned.merge(batch, path, "id", ["written", "payload"], 20)
    assert {r[0]: r[2] for r in state_of(spark, path)}[7] == "19999" and versioned.load(spark, path).rows == 60


def test_prune_and_expire(spark, tmp_path):
    path = str(tmp_path / "state")
    for k in range(4):
        versioned.merge(keyed(spark, range(k * 10, k * 10 + 30), f"v{k}", k + 1), path, "id", ["written", "payload"], 8)
    pruned = versioned.prune(spark, path, F.col("written") >= F.lit("2026-01-03").cast("timestamp_ntz"))
    assert {r[0] for r in state_of(spark, path)} == set(range(20, 60)) and pruned.number == 5
    assert versioned.prune(spark, path, F.lit(True)).number == 5
    versioned.expire(spark, path, keep=1)
    assert versioned.versions(spark, path) == [5] and {r[0] for r in state_of(spark, path)} == set(range(20, 60))
    assert json.loads((tmp_path / "state" / "_versions" / f"{5:012d}.json").read_text())["number"] == 5
    with pytest.raises(FileNotFoundError):
        versioned.snapshot(spark, str(tmp_path / "nothing"))


def test_only_new_or_changed_are_read_again(spark):
    now = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 5)), (3, datetime(2026, 1, 5))], "id bigint, written timestamp_ntz")
    kept = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 1))], "id bigint, written timestamp_ntz")
    got = {r["id"]: r["reason"] for r in incremental.changed_since(now, kept, "id", "written", datetime(2026, 1, 2)).collect()}
    assert got == {2: "changed", 3: "new"}


def alerts_of(spark, *prints):
    return spark.createDataFrame([("no_surgery", "x", 1.0, 0.0, p) for p in prints], "kind string, subject string, value double, limit_value double, fingerprint string")


def test_second_run_raises_nothing(spark, tmp_path):
    root = str(tmp_path / "alerts")
    run = lambda day, *prints: sorted(r["fingerprint"] for r in surveillance.raise_alerts(alerts_of(spark, *prints), root, day, 90).collect())
    assert run(datetime(2026, 8, 1), "f1", "f2", "f2") == ["f1", "f2"]
    assert run(datetime(2026, 8, 2), "f1", "f2", "f3") == ["f3"]
    assert run(datetime(2026, 10, 30), "f1") == []  # ninety days later it is still remembered, and not any longer for that
    assert run(datetime(2026, 10, 31), "f1", "f3") == ["f1"]
    assert run(datetime(2027, 8, 2), "f1", "f2") == ["f1", "f2"]


def test_state_expires_and_a_restart_raises_nothing(spark, tmp_path):
    inbox, out, check = (str(tmp_path / x) for x in ("inbox", "out", "check"))
    start = datetime(2026, 1, 1)

    def run(day, prints):
        alerts_of(spark, *prints).withColumn("raised_at", F.lit(start + timedelta(days=day)).cast("timestamp")).write.mode("append").parquet(inbox)
        query = surveillance.start_alerts(spark.readStream.schema(surveillance.ALERT).parquet(inbox), out, check, keep_days=30)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None

    run(0, [f"a{i}" for i in range(200)] + ["hot"] * 3000)
    assert spark.read.parquet(out).count() == 201
    again = surveillance.start_alerts(spark.readStream.schema(surveillance.ALERT).parquet(inbox), out, check, keep_days=30)
    again.awaitTermination()
    assert spark.read.parquet(out).count() == 201
    run(60, ["b"])
    assert run(61, ["c"]) <= 3  # the first day's fingerprints are gone
    assert spark.read.parquet(out).count() == 203


LINES = "ts timestamp_ntz, product_id bigint, product string, hospital string, case_no string, doctor string, unit string, weighable boolean, duration_min double, qty double"


def test_watched_lines_alert_once(spark, tmp_path):
    source, memory = str(tmp_path / "lines"), str(tmp_path / "memory")
    now = datetime(2026, 8, 1, 12)
    rows = [(now - timedelta(hours=2), 1, "sevo", "N", "C1", "", "mL", False, None, 20.0), (now - timedelta(hours=3), 1, "sevo", "N", "C2", "D", "mL", False, 90.0, 20.0)]
    spark.createDataFrame(rows, LINES).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(spark.createDataFrame([], LINES).schema).parquet(source)
    surveillance.watch_lines(stream(), memory, str(tmp_path / "state"), now).awaitTermination()
    spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(source)
    surveillance.watch_lines(stream(), memory, str(tmp_path / "state"), now).awaitTermination()
    assert spark.read.parquet(memory).count() == 1


def test_stream_days_equal_batch_days(spark, tmp_path):
    source = str(tmp_path / "lines")
    start = datetime(2026, 7, 1)
    rows = [(start + timedelta(hours=5 * i), i % 2, "p", "N", f"C{i}", "D", "pc", False, None, float(i)) for i in range(60)]
    spark.createDataFrame(rows, LINES).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.createDataFrame([], LINES).schema).parquet(source)
    query = surveillance.daily_usage_stream(stream).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["day_start"].date(), r["product_id"]): r["qty"] for r in spark.table("days").collect()}
    batch = spark.read.parquet(source).groupBy(F.col("ts").cast("date").alias("d"), "product_id").agg(F.sum("qty").alias("q")).collect()
    assert got == {(r["d"], r["product_id"]): r["q"] for r in batch}
