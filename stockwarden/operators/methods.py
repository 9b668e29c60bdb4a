"""Forecast methods as column expressions over a series array, rolling-origin trials and the choice of a method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.config import SupplyConfig
from stockwarden.operators.series import KEYS

# Candidate methods in the order ties are resolved, and the grids they search.
REGULAR = ("moving_average_28", "exponential_smoothing", "damped_holt", "weekly_holt_winters", "seasonal_naive")
INTERMITTENT = ("croston_sba", "moving_average_28", "exponential_smoothing")
SES_ALPHAS = (0.05, 0.1, 0.2, 0.3, 0.5)
HOLT_ALPHAS = (0.1, 0.2, 0.4)
HOLT_BETAS = (0.01, 0.05, 0.1)
PHI = 0.9
CROSTON_ALPHA = 0.15


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def _last(y: Column, k: int, skip: int = 0) -> Column:
    return F.slice(y, F.greatest(F.size(y) - (k + skip) + 1, F.lit(1)), F.least(F.lit(k), F.size(y)))


def moving_average(y: Column, h: Column) -> Column:
    return F.array_repeat(F.greatest(F.lit(0.0), array_mean(_last(y, 28))), h)


def exponential_smoothing(y: Column, h: Column) -> Column:
    """Level of the smoothing constant with the lowest one-step squared error; the first one wins ties."""
    start = F.struct(F.get(y, F.lit(0)).alias("l"), F.lit(0.0).alias("e"))
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i")) for i, a in enumerate(SES_ALPHAS)])

    def run(g: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            miss = v - s["l"]
            return F.struct((g["a"] * v + (1 - g["a"]) * s["l"]).alias("l"), (s["e"] + miss * miss).alias("e"))

        return F.aggregate(F.slice(y, 2, F.size(y)), start, step, lambda s: F.struct(s["e"].alias("e"), g["i"].alias("i"), s["l"].alias("l")))

    return F.array_repeat(F.greatest(F.lit(0.0), F.array_min(F.transform(grid, run))["l"]), h)


def _holt_state(y: Column) -> Column:
    """Level and trend of the best of the 3 x 3 damped-trend grid."""
    reach = F.least(F.lit(7), F.size(y) - 1)
    slope = (F.get(y, reach) - F.get(y, F.lit(0))) / F.greatest(reach, F.lit(1))
    start = F.struct(F.get(y, F.lit(0)).alias("l"), slope.alias("t"), F.lit(0.0).alias("e"))
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(i * len(HOLT_BETAS) + j).alias("i"))
                     for i, a in enumerate(HOLT_ALPHAS) for j, b in enumerate(HOLT_BETAS)])

    def run(g: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            ahead = s["l"] + PHI * s["t"]
            level = g["a"] * v + (1 - g["a"]) * ahead
            return F.struct(level.alias("l"), (g["b"] * (level - s["l"]) + (1 - g["b"]) * PHI * s["t"]).alias("t"),
                            (s["e"] + (v - ahead) * (v - ahead)).alias("e"))

        return F.aggregate(F.slice(y, 2, F.size(y)), start, step, lambda s: F.struct(s["e"].alias("e"), g["i"].alias("i"), s["l"].alias("l"), s["t"].alias("t")))

    return F.array_min(F.transform(grid, run))


def _damped(k: Column) -> Column:
    return PHI * (1 - F.pow(F.lit(PHI), k)) / (1 - PHI)


def damped_holt(y: Column, h: Column) -> Column:
    # the state sits in a one-element array so that the search runs once for all steps
    return F.flatten(F.transform(F.array(_holt_state(y)), lambda s: F.transform(
        F.sequence(F.lit(1), h), lambda k: F.greatest(F.lit(0.0), s["l"] + _damped(k) * s["t"]))))


def weekday_index(y: Column) -> Column:
    """Mean per position in the week over the mean of those means, clipped to 0.2–3."""
    means = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: array_mean(F.filter(y, lambda v, i: i % 7 == d)))
    scaled = F.flatten(F.transform(F.array(means), lambda m: F.transform(
        m, lambda x: F.least(F.greatest(x / array_mean(m), F.lit(0.2)), F.lit(3.0)))))
    return F.when((F.size(y) >= 14) & (array_sum(y) > 0), scaled).otherwise(F.array_repeat(F.lit(1.0), 7))


def weekly_holt_winters(y: Column, h: Column) -> Column:
    n = F.size(y)

    def run(index: Column) -> Column:
        flat = F.transform(y, lambda v, i: v / F.get(index, i % 7))
        return F.transform(damped_holt(flat, h), lambda v, k: F.greatest(F.lit(0.0), v * F.get(index, (n + k) % 7)))

    return F.flatten(F.transform(F.array(weekday_index(y)), run))


def seasonal_naive(y: Column, h: Column) -> Column:
    n = F.size(y)
    week = F.transform(F.sequence(F.lit(0), h - 1), lambda k: F.greatest(
        F.lit(0.0), (F.get(y, n - 7 + k % 7) + F.get(y, n - 14 + k % 7)) / 2))
    return F.when(n >= 14, week).otherwise(moving_average(y, h))


def croston_sba(y: Column, h: Column) -> Column:
    """Smoothed size over smoothed interval with the SBA correction; zero for a series without demand."""
    first = F.array_position(F.transform(y, lambda v: v > 0), True).cast("int")
    a = CROSTON_ALPHA
    start = F.struct(F.get(y, first - 1).alias("z"), first.cast("double").alias("p"), F.lit(1.0).alias("q"))

    def step(s: Column, v: Column) -> Column:
        used = v > 0
        return F.struct(
            F.when(used, a * v + (1 - a) * s["z"]).otherwise(s["z"]).alias("z"),
            F.when(used, a * s["q"] + (1 - a) * s["p"]).otherwise(s["p"]).alias("p"),
            F.when(used, 1.0).otherwise(s["q"] + 1.0).alias("q"))

    rate = F.aggregate(F.slice(y, first + 1, F.size(y)), start, step, lambda s: F.greatest(F.lit(0.0), (1 - a / 2) * s["z"] / s["p"]))
    return F.array_repeat(F.when(first > 0, rate).otherwise(0.0), h)


METHODS = {
    "moving_average_28": moving_average,
    "exponential_smoothing": exponential_smoothing,
    "damped_holt": damped_holt,
    "weekly_holt_winters": weekly_holt_winters,
    "seasonal_naive": seasonal_naive,
    "croston_sba": croston_sba,
}


def forecast(method: Column, y: Column, h: Column) -> Column:
    """The named method's forecast; CASE branches are lazy, so a row runs only its own method."""
    out = F.lit(None).cast("array<double>")
    for name, run in METHODS.items():
        out = F.when(method == name, run(y, h)).otherwise(out)
    return out


def weekly_blocks(values: Column, n: int = 7) -> Column:
    blocks = F.floor(F.size(values) / n).cast("int")
    sums = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: array_sum(F.slice(values, b * n + 1, n)))
    return F.when(blocks >= 1, sums).otherwise(F.array(array_sum(values)))


def wape(actual: Column, predicted: Column) -> Column:
    base = array_sum(F.transform(actual, lambda v: F.abs(v)))
    miss = array_sum(F.zip_with(actual, predicted, lambda a, p: F.abs(a - p)))
    silent = array_sum(F.transform(predicted, lambda v: F.abs(v))) == 0
    return F.when(base > 0, miss / base).when(silent, 0.0).otherwise(1.0)


def rank_keys(series: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Every key gets every method on every fold. Only if the caller sets `max_backtests`, the keys with fewest lines get one
    method on the last window."""
    if cfg.max_backtests is None:
        return series.withColumn("full", F.lit(True))
    busiest = series.select(*KEYS, "lines").orderBy(F.desc("lines"), *KEYS).limit(max(1, cfg.max_backtests))
    return series.join(busiest.select(*KEYS, F.lit(True).alias("full")), KEYS, "left").withColumn("full", F.coalesce("full", F.lit(False)))


def trials(series: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """One row per key, candidate method and fold: WAPE on weekly blocks and the daily residuals."""
    c, fold = F.col, cfg.fold_days
    folds = F.when(c("n") < fold * (cfg.folds + 1) + 7, F.greatest(F.lit(1), F.floor((c("n") - 14) / fold).cast("int"))).otherwise(cfg.folds)
    cuts = F.filter(F.transform(F.sequence(F.lit(1), c("k")), lambda i: c("n") - i * fold), lambda x: x >= 14)
    one_cut = F.array(F.greatest(F.lit(14), c("n") - fold))
    names = lambda ms: F.array(*[F.lit(m) for m in ms])
    quick = F.when(c("intermittent"), names(["croston_sba"])).otherwise(names(["moving_average_28"]))
    candidates = F.when(~c("full"), quick).when(c("intermittent"), names(INTERMITTENT)).otherwise(names(REGULAR))
    rows = series.filter(~c("insufficient")).withColumn("k", folds)
    rows = rows.select(*KEYS, "y", F.explode(F.when(c("full"), cuts).otherwise(one_cut)).alias("cut"), candidates.alias("candidates"))
    rows = rows.select(*KEYS, "y", "cut", F.posexplode("candidates").alias("order", "method"))
    rows = rows.withColumn("actual", F.slice("y", c("cut") + 1, fold)).filter(F.size("actual") > 0)
    rows = rows.withColumn("predicted", forecast(c("method"), F.slice("y", 1, c("cut")), F.size("actual")))
    return rows.select(
        *KEYS, "method", "order", "cut", wape(weekly_blocks(c("actual")), weekly_blocks(c("predicted"))).alias("wape"),
        F.zip_with("actual", "predicted", lambda a, p: a - p).alias("residuals"), array_sum(c("actual")).alias("actual_total"))


def choose_method(trial_rows: DataFrame) -> DataFrame:
    """Lowest mean WAPE per key, with the residual spread and bias of that method. A key has at most 15 trial rows."""
    c = F.col
    scored = trial_rows.groupBy(*KEYS, "method", "order").agg(
        F.avg("wape").alias("wape"), F.flatten(F.collect_list("residuals")).alias("residuals"), F.sum("actual_total").alias("actual"))
    best = scored.groupBy(*KEYS).agg(F.min_by(F.struct("method", "wape", "residuals", "actual"), F.struct("wape", "order")).alias("b")).select(*KEYS, "b.*")
    mean = array_mean(c("residuals"))
    spread = F.sqrt(array_mean(F.transform(c("residuals"), lambda r: (r - c("m")) * (r - c("m")))))
    return best.withColumn("m", mean).select(
        *KEYS, "method", "wape", F.size("residuals").alias("n_residuals"), spread.alias("residual_sd"),
        F.when(c("actual") >= 1.0, array_sum(c("residuals")) / c("actual")).otherwise(0.0).alias("bias"))


def forecasts(series: DataFrame, chosen: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """The chosen method over the horizon, with its sigma; a flat mean where the history is insufficient."""
    c, h = F.col, F.lit(cfg.horizon)
    rows = series.join(chosen, KEYS, "left").withColumn("method", F.coalesce("method", F.lit("insufficient")))
    rows = rows.withColumn("mean", array_mean(c("y")))
    rows = rows.withColumn("f", F.when(c("method") == "insufficient", F.array_repeat(c("mean"), cfg.horizon)).otherwise(forecast(c("method"), c("y"), h)))
    sd = lambda y, m: F.sqrt(array_mean(F.transform(y, lambda v: (v - m) * (v - m))))
    tail = F.slice("y", F.greatest(c("n") - 55, F.lit(1)), 56)
    rows = rows.withColumns({"tail": tail, "daily": array_mean(c("f"))}).withColumn("tail_mean", array_mean(c("tail")))
    own = F.when(c("n_residuals") > 3, c("residual_sd")).otherwise(sd(c("tail"), c("tail_mean")))
    plain = F.greatest(F.when(c("n") > 1, sd(c("y"), c("mean"))).otherwise(c("mean")), 0.5 * c("mean"), F.lit(1e-9))
    sigma = F.when(c("method") == "insufficient", plain).otherwise(F.greatest(own, 0.05 * F.greatest(c("daily"), F.lit(1e-9))))
    return rows.withColumn("sigma", sigma).drop("y", "tail", "tail_mean", "mean", "n_residuals", "residual_sd")


def daily_forecasts(chosen: DataFrame, cfg: SupplyConfig) -> DataFrame:
    """Long form: one row per key and future day with the interval."""
    c = F.col
    steps = chosen.select(*KEYS, "product", "method", "wape", "sigma", F.posexplode("f").alias("i", "forecast"))
    return steps.select(
        *KEYS, "product", "method", "wape", (c("i") + 1).alias("step"), F.date_add(F.lit(cfg.as_of), c("i") + 1).alias("day"), "forecast",
        F.greatest(F.lit(0.0), c("forecast") - cfg.z * c("sigma")).alias("lower"), (c("forecast") + cfg.z * c("sigma")).alias("upper"))


def trailing_mean(daily: DataFrame, keys: list[str], rows: int = 28) -> DataFrame:
    """Trailing mean and mean of the last two same weekdays over a dense daily table, by window frames."""
    order = Window.partitionBy(*keys).orderBy("day")
    return daily.withColumns({
        "mean_28": F.avg("qty").over(order.rowsBetween(-(rows - 1), 0)),
        "weekday_naive": (F.lag("qty", 7).over(order) + F.lag("qty", 14).over(order)) / 2})
