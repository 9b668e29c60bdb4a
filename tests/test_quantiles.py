import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockwarden.operators import quantiles as Q


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.round(rng.lognormal(3, 1.2, 6000), 2)})
    cold = pd.DataFrame({"k": rng.choice(list("abcdef"), 3000), "v": np.round(rng.normal(0, 5, 3000), 1)})
    same = pd.DataFrame({"k": "same", "v": 7.0}, index=range(500))
    return pd.concat([hot, cold, same])


def test_matches_linear_interpolation(spark, skewed):
    probs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = Q.value_counts(spark.createDataFrame(skewed), ["k"], "v")
    got = Q.quantiles_of_counts(counts, ["k"], "v", probs).toPandas().set_index("k")
    for key, group in skewed.groupby("k"):
        assert got.loc[key, "total"] == len(group)
        for name, p in probs.items():
            assert got.loc[key, name] == pytest.approx(np.percentile(group["v"], 100 * p), abs=1e-9)


def test_single_row_and_weights(spark):
    df = spark.createDataFrame([("a", 2.0, 3), ("a", 5.0, 1), ("b", -1.0, 1)], "k string, v double, w bigint")
    got = {r["k"]: r for r in Q.grouped_quantiles(df, ["k"], "v", {"m": 0.5}, weight="w").collect()}
    assert got["a"]["m"] == 2.0 and got["a"]["total"] == 4 and got["b"]["m"] == -1.0


def test_no_task_orders_more_than_a_small_share_of_a_hot_key(spark):
    rows = spark.range(2_000_000).select(F.lit("hot").alias("k"), (0.4 + 0.4 * F.col("id") / 2_000_000).alias("v"))
    counts = Q.value_counts(rows, ["k"], "v")
    widest = counts.groupBy(Q.value_step(F.col("v")).alias("b")).count().agg(F.max("count")).first()[0]
    assert widest < 2_000
    got = Q.quantiles_of_counts(counts, ["k"], "v", {"m": 0.5}).first()
    assert got["total"] == 2_000_000 and got["m"] == pytest.approx(0.6, abs=1e-6)
