"""Lines are hashed, not sorted, before they are few; coarse tests of ids and both ways to profiles change no result."""

from datetime import date, datetime

from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig, SupplyConfig
from stockwarden.operators import features, patterns, profiles, rules, series, sieve
from stockwarden.session import materialize


def _lines(spark, n=400):
    rows = [(f"l{i}", datetime(2001, 1 + i % 6, 1 + i % 28, i % 24), f"C{i // 3}", ["North", "South"][i % 2], ["Ada", "", "Bo"][i % 3], f"T{i % 4}",
             f"W{i % 2}", i % 5, f"agent {i % 5} {'ab'[i % 2]}", "mL" if i % 5 < 3 else "pc", float(1 + i * 7 % 23), float(i % 11), (1 + i * 7 % 23) / (5.0 + i % 13) if i % 5 < 3 else None)
            for i in range(n)]
    return spark.createDataFrame(rows, "line_id string, ts timestamp_ntz, case_no string, hospital string, doctor string, technician string, sublocation string, "
                                 "product_id bigint, product string, unit string, qty double, amount double, rate double").withColumn("day", F.to_date("ts"))


def _first_aggregate(df):
    """The aggregate nearest to the rows that are read."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in line][-1]


def _watched(monkeypatch, module):
    seen = {}

    def write(df, name, *more):
        seen[name] = _first_aggregate(df) if "Aggregate(" in df._jdf.queryExecution().executedPlan().toString() else ""
        return materialize(df, name, *more)

    monkeypatch.setattr(module, "materialize", write)
    return seen


def test_lines_are_hashed_for_profiles_patterns_series_and_products(spark, monkeypatch):
    lines = _lines(spark)
    seen = _watched(monkeypatch, profiles)
    profiles.build_profiles(lines)
    assert "HashAggregate" in seen["profile-counts"]
    seen = _watched(monkeypatch, patterns)
    flagged = lines.filter("line_id < 'l2'")
    patterns.level_shifts(lines, flagged, ConsumptionConfig())
    patterns.actor_deviations(lines, flagged, ConsumptionConfig())
    assert "HashAggregate" in seen["level-sums"] and "HashAggregate" in seen["actor-sums"]
    assert "HashAggregate" in _first_aggregate(patterns.extreme_days(lines, ConsumptionConfig()))
    assert "HashAggregate" in _first_aggregate(features.container_capacity(lines))
    daily = series.daily_series(lines.withColumn("location", F.col("hospital")), SupplyConfig(as_of=date(2001, 8, 1)))
    assert "HashAggregate" in _first_aggregate(daily)


def test_profiles_do_not_depend_on_the_way(spark, monkeypatch):
    lines = _lines(spark)
    order = ["scope", "key", "metric"]

    def result():
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in profiles.build_profiles(lines).orderBy(*order).collect()]

    sorted_way = result()
    monkeypatch.setattr(profiles, "SORTED_VALUES", 4)
    mixed = result()
    monkeypatch.setattr(profiles, "SORTED_VALUES", 0)
    assert sorted_way == mixed == result() and len(sorted_way) > 40
    expected = lines.filter("product_id = 1 and hospital = 'North'").agg(
        F.percentile("qty", 0.5), F.percentile("qty", 0.95), F.stddev_samp("qty"), F.min("product")).first()
    row = profiles.build_profiles(lines).filter("scope = 'product_hospital' and key = '1|North' and metric = 'qty'").first()
    assert (row["median"], row["p95"], round(row["sd"], 9), row["label"]) == (expected[0], expected[1], round(expected[2], 9), expected[3])


def test_bitmap_keeps_every_wanted_line(spark):
    lines = spark.range(5_000).select(F.concat(F.lit("x"), "id").alias("line_id")).union(spark.sql("select cast(null as string)"))
    wanted = lines.filter("line_id is null or line_id like '%7'")
    marked = sieve.may_match(lines, sieve.bitmap(wanted, "line_id"), "line_id", "near")
    assert marked.count() == 5_001
    assert marked.filter("line_id like '%7' and not near").count() == 0
    assert marked.filter("near").count() < 600  # 500 wanted ones and hardly another
    assert marked.filter("line_id is null and near").count() == 0


def test_repeated_ids_meet_every_flag(spark):
    lines = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "line_id string, x int")
    flagged = spark.createDataFrame([("a",), ("a",), (None,)], "line_id string")
    got = sorted((r["x"], r["fresh"]) for r in patterns._marked(lines, flagged).collect())
    assert got == [(1, False), (1, False), (2, False), (2, False), (3, True), (4, True)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scopes_are_grouping_sets_and_blank_entities_drop_out(spark):
    lines = _lines(spark).withColumn("technician", F.when(F.col("product_id") == 4, " ").when(F.col("product_id") != 3, F.col("technician")))
    profile_table = profiles.build_profiles(lines)
    cuts = profiles.cutoffs(lines, profile_table, ConsumptionConfig())
    assert "Generate" not in _plan(profiles._scope_groups(lines, profiles.SCOPES, {"n": F.count("*")}))
    got = {(r["scope"], r["product_id"], r["entity"]): r["n"] for r in profiles._scope_groups(lines, profiles.SCOPES, {"n": F.count("*")}).collect()}
    expected = {}
    for r in lines.collect():
        for scope, column in profiles.SCOPES.items():
            entity = "" if column is None else r[column]
            if column is None or (entity or "").strip():
                expected[scope, r["product_id"], entity] = expected.get((scope, r["product_id"], entity), 0) + 1
    assert got == expected
    assert cuts.filter("scope = 'product_technician' and product_id in (3, 4)").count() == 0
    assert cuts.filter("scope = 'product'").count() == 5


def test_hits_are_built_without_functions_over_arrays(spark):
    cfg, lines = ConsumptionConfig(), _lines(spark)
    more = lines.selectExpr("*", "rate is not null as volatile", "doctor = '' as no_doctor", "30D as duration_min", "hour(ts) > 21 as night", "false as weekend", "false as weighable",
                            "10D as weight_start", "9D as weight_end", "cast(null as double) as measured_ml", "cast(null as double) as density", "100D as capacity", "1D as product_rate",
                            "ts as expiry")
    assert "lambdafunction" not in _plan(rules.local_hits(more, cfg))
    cuts = materialize(profiles.cutoffs(lines, profiles.build_profiles(lines), cfg), "cuts")
    assert "lambdafunction" not in _plan(rules.z_hits(more, cuts, cfg))


def test_lines_are_not_shuffled_to_the_few_foreign_lots(spark):
    lines = _lines(spark).withColumn("lot", F.lit("L1")).withColumn("hospital", F.when(F.col("line_id") == "l7", "South").otherwise("North"))
    path = materialize(lines, "lot-lines")
    hits = rules.travelling_lots(path, ConsumptionConfig())
    assert [r["line_id"] for r in hits.collect()] == ["l7"]
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
