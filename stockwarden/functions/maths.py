"""Column expressions for scores, rounding and stock formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def robust_z(x: Column, median: Column, mad: Column, sd: Column) -> Column:
    scale = F.when(mad > 1e-9, 1.4826 * mad).otherwise(F.coalesce(sd, F.lit(0.0)))
    return F.when(scale > 1e-9, (x - median) / scale).otherwise(0.0)


def round_unit(qty: Column, decimals: Column, mode: str = "nearest") -> Column:
    """Rounding at a unit's precision: half-even, up for amounts to supply, down for amounts available."""
    factor = F.pow(F.lit(10.0), decimals)
    scaled = qty * factor
    steps = {
        "nearest": F.rint(scaled),
        "up": F.ceil(scaled - 1e-9).cast("double"),
        "down": F.floor(scaled + 1e-9).cast("double"),
    }[mode]
    return steps / factor


def decimals_from_step(step: Column) -> Column:
    """0.01 -> 2, 1 -> 0, never outside 0..6."""
    raw = F.when(step >= 1, 0).otherwise(F.rint(-F.log10(step)).cast("int"))
    return F.greatest(F.lit(0), F.least(raw, F.lit(6)))


def to_base_unit(qty: Column, factor_from: Column, factor_to: Column) -> Column:
    return F.coalesce(qty / F.nullif(factor_from, F.lit(0.0)) * F.nullif(factor_to, F.lit(0.0)), qty)


def to_multiple(qty: Column, multiple: Column) -> Column:
    return F.when(qty > 0, F.ceil(qty / multiple - 1e-9) * multiple).otherwise(0.0)


def safety_stock(z: float, lead_time: Column, sigma: Column, daily: Column, lead_time_sigma: Column) -> Column:
    variance = F.greatest(lead_time, F.lit(1.0)) * sigma * sigma + daily * daily * lead_time_sigma * lead_time_sigma
    return F.lit(z) * F.sqrt(variance)


def reorder_point(daily: Column, lead_time: Column, safety: Column) -> Column:
    return daily * lead_time + safety


def saturation_index(points: Column, lines: Column) -> Column:
    """Points per 100 lines when there are 20 lines or more, points alone below that; both saturate at 100."""
    density = 100.0 * points / F.greatest(lines, F.lit(1))
    return F.when(lines >= 20, 100 * (1 - F.exp(-density / 12))).otherwise(100 * (1 - F.exp(-points / 25)))


def usage_cost(tokens_in: Column, tokens_out: Column, cache_write: Column, cache_read: Column,
               price_in: Column, price_out: Column, read_weight: Column) -> Column:
    """Input equivalent (writes weigh 1.25, reads the model's own weight) times price per million."""
    equivalent = F.rint(tokens_in + cache_write * 1.25 + cache_read * read_weight)
    return equivalent / 1e6 * price_in + tokens_out / 1e6 * price_out


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
