"""Isolation forest: trees are grown on seeded hash samples, one task per tree, and lines are scored in Arrow batches."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.config import ConsumptionConfig
from stockwarden.operators.quantiles import grouped_quantiles
from stockwarden.operators.rules import _hit
from stockwarden.session import materialize

FEATURES = ("qty_log", "f_rate", "f_hour", "f_weekday", "f_night", "f_weekend", "f_no_doctor", "f_duration", "f_volatile", "qty_rel")


def feature_rows(lines: DataFrame) -> DataFrame:
    """Ten features per line; the quantity is also taken relative to its product's median."""
    c = F.col
    medians = grouped_quantiles(lines, ["product_id"], "qty", {"product_median": 0.5}).select("product_id", "product_median")
    medians = materialize(medians, "product-medians")
    rate = grouped_quantiles(lines.select(F.lit(1).alias("one"), "rate"), ["one"], "rate", {"m": 0.5}).select("m").scalar()
    rows = lines.join(medians, "product_id").withColumn("rate_median", F.coalesce(rate, F.lit(0.0)))
    as_number = {"f_night": "night", "f_weekend": "weekend", "f_no_doctor": "no_doctor", "f_volatile": "volatile"}
    return rows.select(
        "line_id", F.log1p(F.greatest(c("qty"), F.lit(0.0))).alias("qty_log"), F.coalesce("rate", "rate_median").alias("f_rate"),
        c("hour").cast("double").alias("f_hour"), c("weekday").cast("double").alias("f_weekday"),
        *[c(v).cast("int").cast("double").alias(k) for k, v in as_number.items()], F.coalesce("duration_min", F.lit(0.0)).alias("f_duration"),
        (c("qty") / F.when(c("product_median") == 0, 1.0).otherwise(c("product_median"))).alias("qty_rel"))


def _path_normal(n: float) -> float:
    return 0.0 if n <= 1 else (1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append the subtree of `x` to `nodes` as [feature, cut, left, right, path]; feature -1 is a leaf."""
    at = len(nodes)
    nodes.append([-1, 0.0, -1, -1, depth + _path_normal(len(x))])
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else ()
    if depth < limit and len(spread):
        f = int(rng.choice(spread))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        left = x[:, f] <= cut
        nodes[at] = [f, cut, _grow(x[left], rng, depth + 1, limit, nodes), _grow(x[~left], rng, depth + 1, limit, nodes), 0.0]
    return at


def grow_trees(features: DataFrame, cfg: ConsumptionConfig, rows: int, seed: int = 7) -> DataFrame:
    """Each line draws its trees by hash, so only about 1.5 samples' worth of rows per tree ever moves.

    On a large table that is one hash per line and a chance near zero; on a small one a line may serve many trees.
    Every tree then keeps its `size` smallest draws.
    """
    size = min(cfg.sample_size, rows)
    per_line = 1.5 * size * cfg.trees / rows
    draws = math.ceil(per_line)
    accept = int(per_line / draws * 2**31)
    tries = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda i: F.xxhash64("line_id", i, F.lit(seed)))
    kept = F.filter(tries, lambda h: F.pmod(h, F.lit(2**31)) < accept)
    drawn = features.select(*FEATURES, F.explode(kept).alias("draw")).withColumn(
        "tree", F.pmod(F.shiftright("draw", 31), F.lit(cfg.trees)).cast("int"))
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        chosen = sample.sort_values("draw").head(size)
        nodes: list = []
        _grow(chosen[list(FEATURES)].to_numpy(), np.random.default_rng(seed * 1000 + key[0]), 0, limit, nodes)
        return pd.DataFrame({"tree": [key[0]], "sample": [len(chosen)], "nodes": [json.dumps(nodes)]})

    return drawn.groupBy("tree").applyInPandas(grow, "tree int, sample int, nodes string")


def _walkable(nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tree as arrays in which a leaf leads to itself, so that a fixed number of steps ends in the leaf."""
    own = np.arange(len(nodes))
    leaf = nodes[:, 0] < 0
    pick = lambda column: np.where(leaf, own, nodes[:, column]).astype(np.int32)
    return np.where(leaf, 0, nodes[:, 0]).astype(np.int32), nodes[:, 1], pick(2), pick(3), nodes[:, 4]


def score_lines(features: DataFrame, trees: DataFrame) -> DataFrame:
    """Anomaly score 2^(-mean path / c). The forest is `cfg.trees` small rows, a bound set by the configuration."""
    grown = [(r.sample, np.array(json.loads(r.nodes))) for r in trees.orderBy("tree").collect()]
    sample = max(s for s, _ in grown)
    forest = features.sparkSession.sparkContext.broadcast([_walkable(nodes) for _, nodes in grown])
    norm, steps, width = max(_path_normal(sample), 1e-9), math.ceil(math.log2(max(sample, 2))), len(FEATURES)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.ascontiguousarray(batch[list(FEATURES)].to_numpy()).ravel()
            row, total = np.arange(len(batch)) * width, np.zeros(len(batch))
            for feature, cut, left, right, path in forest.value:
                at = np.zeros(len(batch), dtype=np.int32)
                for _ in range(steps):
                    at = np.where(values[row + feature[at]] <= cut[at], left[at], right[at])
                total += path[at]
            yield pd.DataFrame({"line_id": batch["line_id"], "score": np.power(2.0, -total / len(forest.value) / norm)})

    return features.select("line_id", *FEATURES).mapInPandas(score, "line_id string, score double")


def forest_scores(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    features = materialize(feature_rows(lines), "forest-features")
    return score_lines(features, grow_trees(features, cfg, features.count()))


def forest_hits(lines: DataFrame, cfg: ConsumptionConfig) -> DataFrame:
    """Lines in the top `contamination` share of the scores and above 0.60; nothing below 200 lines."""
    scores = materialize(forest_scores(lines, cfg), "forest-scores")
    cut = grouped_quantiles(scores.withColumn("one", F.lit(1)), ["one"], "score", {"cut": 1 - cfg.contamination})
    rows = scores.withColumns({"cut": cut.select("cut").scalar(), "rows": cut.select("total").scalar()})
    kept = rows.filter((F.col("rows") >= 200) & (F.col("score") >= F.col("cut")) & (F.col("score") > 0.60))
    contrib = F.least((F.col("score") - 0.55) * 4, F.lit(1.5))
    reason = F.format_string("unusual combination of features (score %.2f)", "score")
    return kept.select("line_id", _hit("isolation_forest", cfg, contrib, reason).alias("h")).select("line_id", "h.*")
