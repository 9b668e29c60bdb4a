"""Feedback of people moves the thresholds of the profiles involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shift per label and the range it may reach.
EFFECTS = {"justified": 0.15, "discarded": 0.15, "confirmed": -0.15}
LIMIT = 1.5


def _effect(status: Column) -> Column:
    out = F.lit(0.0)
    for label, value in EFFECTS.items():
        out = F.when(status == label, value).otherwise(out)
    return out


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-LIMIT), F.least(x, F.lit(LIMIT)))


def label_changes(feedback: DataFrame) -> DataFrame:
    """Shift each label causes: its effect less that of the finding's previous label; repeating a label does nothing."""
    by_finding = Window.partitionBy("finding_id").orderBy("labelled_at", "event_id")
    shift = _effect(F.col("status")) - _effect(F.coalesce(F.lag("status").over(by_finding), F.lit("new")))
    return feedback.withColumn("delta", F.round(shift, 2)).filter("delta <> 0")


def threshold_shifts(changes: DataFrame) -> DataFrame:
    """Running shift per profile, clipped after every update.

    Adding and clipping turns x into min(u, max(l, x + a)); such steps compose into one of the same form. So each hour
    of a profile is first reduced to its (a, l, u), and the hours are then composed: no profile's history is one list.
    """
    c = F.col
    scopes = F.array(
        F.struct(F.lit("product").alias("scope"), c("product_id").cast("string").alias("base")),
        F.struct(F.lit("product_hospital").alias("scope"), F.concat_ws("|", "product_id", "hospital").alias("base")),
        F.struct(F.lit("product_doctor").alias("scope"), F.concat_ws("|", "product_id", "doctor").alias("base")))
    metrics = F.array(F.lit("qty"), F.lit("rate"))
    rows = changes.select("labelled_at", "event_id", "delta", F.explode(scopes).alias("s")).select("labelled_at", "event_id", "delta", "s.scope", c("s.base").alias("key"), F.explode(metrics).alias("metric"))
    keys = ["scope", "key", "metric"]
    start = F.struct(F.lit(0.0).alias("a"), F.lit(-1e9).alias("l"), F.lit(1e9).alias("u"))

    def add(s: Column, d: Column) -> Column:
        return F.struct((s["a"] + d).alias("a"), _clip(s["l"] + d).alias("l"), _clip(s["u"] + d).alias("u"))

    def then(s: Column, f: Column) -> Column:
        bound = lambda x: F.greatest(f["l"], F.least(x + f["a"], f["u"]))
        return F.struct((s["a"] + f["a"]).alias("a"), bound(s["l"]).alias("l"), bound(s["u"]).alias("u"))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("labelled_at", "event_id", "delta"))), lambda e: e["delta"])
    hourly = rows.groupBy(*keys, F.date_trunc("hour", "labelled_at").alias("hour")).agg(ordered.alias("deltas"), F.count_if(c("delta") > 0).alias("up"), F.count_if(c("delta") < 0).alias("down"))
    hourly = hourly.withColumn("step", F.aggregate("deltas", start, add))
    total = hourly.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hour", "step"))).alias("hours"), F.sum("up").alias("justified"), F.sum("down").alias("confirmed"))
    end = F.aggregate("hours", start, lambda s, d: then(s, d["step"]))
    return total.withColumn("f", end).select(*keys, F.greatest(c("f.l"), F.least(c("f.a"), c("f.u"))).alias("threshold_adj"), "justified", "confirmed")
