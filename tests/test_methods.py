"""Forecast methods and the choice of a method against a plain restatement of their definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.operators import methods as M
from stockwarden.operators.series import KEYS

from datetime import date

RNG = np.random.default_rng(11)
SERIES = {
    "weekly": np.round(20 + 8 * np.sin(2 * np.pi * np.arange(150) / 7) + RNG.normal(0, 2, 150), 2).clip(0),
    "trend": np.round(5 + 0.2 * np.arange(120) + RNG.normal(0, 1, 120), 2).clip(0),
    "lumpy": np.where(RNG.random(200) < 0.15, RNG.integers(1, 30, 200), 0).astype(float),
    "short": np.round(RNG.random(33) * 4, 1),
}


def level_after(values, alpha):
    level, error = values[0], 0.0
    for v in values[1:]:
        error += (v - level) ** 2
        level += alpha * (v - level)
    return error, level


def plain_smoothing(values, h):
    return np.repeat(max(0.0, min((level_after(values, a) for a in M.SES_ALPHAS), key=lambda x: x[0])[1]), h)


def plain_holt(values, h):
    best = None
    reach = min(7, len(values) - 1)
    for a, b in itertools.product(M.HOLT_ALPHAS, M.HOLT_BETAS):
        level, trend, error = values[0], (values[reach] - values[0]) / max(1, reach), 0.0
        for v in values[1:]:
            expected = level + M.PHI * trend
            error += (v - expected) ** 2
            updated = a * v + (1 - a) * expected
            level, trend = updated, b * (updated - level) + (1 - b) * M.PHI * trend
        if best is None or error < best[0]:
            best = (error, level, trend)
    growth = np.cumsum(M.PHI ** np.arange(1, h + 1))
    return np.maximum(0.0, best[1] + growth * best[2])


def plain_weekly(values, h):
    position = np.arange(len(values)) % 7
    index = np.array([values[position == d].mean() for d in range(7)])
    index = np.clip(index / index.mean(), 0.2, 3.0)
    return np.maximum(0.0, plain_holt(values / index[position], h) * index[(len(values) + np.arange(h)) % 7])


def plain_naive(values, h):
    week = (values[-7:] + values[-14:-7]) / 2
    return np.resize(week, h)


def plain_croston(values, h):
    used = np.flatnonzero(values > 0)
    size, gap = values[used[0]], used[0] + 1.0
    for before, now in zip(used, used[1:]):
        size += M.CROSTON_ALPHA * (values[now] - size)
        gap += M.CROSTON_ALPHA * ((now - before) - gap)
    return np.repeat((1 - M.CROSTON_ALPHA / 2) * size / gap, h)


PLAIN = {
    "moving_average_28": lambda v, h: np.repeat(v[-28:].mean(), h), "exponential_smoothing": plain_smoothing, "damped_holt": plain_holt,
    "weekly_holt_winters": plain_weekly, "seasonal_naive": plain_naive, "croston_sba": plain_croston,
}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, name, v.tolist(), len(v), False, bool((v == 0).mean() > 0.6), True) for i, (name, v) in enumerate(SERIES.items())]
    return spark.createDataFrame(rows, "product_id bigint, location string, y array<double>, n int, insufficient boolean, intermittent boolean, full boolean").cache()


@pytest.mark.parametrize("method", PLAIN)
def test_method(frame, method):
    got = frame.select("location", M.METHODS[method](F.col("y"), F.lit(14)).alias("f")).collect()
    for row in got:
        np.testing.assert_allclose(row["f"], PLAIN[method](SERIES[row["location"]], 14), atol=1e-9)


def blocks(x):
    k = len(x) // 7
    return x[: 7 * k].reshape(k, 7).sum(axis=1) if k else np.array([x.sum()])


def plain_choice(values, cfg):
    names = M.INTERMITTENT if (values == 0).mean() > 0.6 else M.REGULAR
    folds = cfg.folds if len(values) >= cfg.fold_days * (cfg.folds + 1) + 7 else max(1, (len(values) - 14) // cfg.fold_days)
    scores = {}
    for name in names:
        errors = []
        for i in range(1, folds + 1):
            cut = len(values) - i * cfg.fold_days
            if cut >= 14:
                actual = values[cut:cut + cfg.fold_days]
                predicted = PLAIN[name](values[:cut], len(actual))
                total = blocks(actual).sum()
                errors.append(np.abs(blocks(actual) - blocks(predicted)).sum() / total if total > 0 else float(predicted.sum() > 0))
        scores[name] = np.mean(errors)
    return min(scores, key=scores.get), scores


def test_choice_matches_plain_backtest(frame):
    cfg = SupplyConfig(as_of=date(2024, 1, 1))
    got = {r["location"]: r for r in M.choose_method(M.trials(frame, cfg)).collect()}
    for name, values in SERIES.items():
        method, scores = plain_choice(values, cfg)
        assert got[name]["method"] == method
        assert got[name]["wape"] == pytest.approx(scores[method], abs=1e-9)


def test_quick_tier_uses_one_window(frame):
    cfg = SupplyConfig(as_of=date(2024, 1, 1))
    rows = M.trials(frame.withColumn("full", F.lit(False)), cfg).collect()
    assert len(rows) == len(SERIES)
    assert {r["location"]: r["method"] for r in rows}["lumpy"] == "croston_sba"


def test_result_does_not_depend_on_partitions(frame):
    cfg = SupplyConfig(as_of=date(2024, 1, 1))
    one = M.choose_method(M.trials(frame.coalesce(1), cfg)).orderBy(*KEYS).collect()
    many = M.choose_method(M.trials(frame.repartition(7), cfg)).orderBy(*KEYS).collect()
    assert [r["method"] for r in one] == [r["method"] for r in many]
