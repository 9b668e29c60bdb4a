"""Periodic surveillance: five checks as one alert table, each alert raised once per fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stockwarden.config import PENDING_STATES
from stockwarden.functions.text import alert_fingerprint, fixed, present
from stockwarden.operators.features import is_volatile
from stockwarden.operators.history import scheduled_load, typical_cases
from stockwarden.operators.series import KEYS

COLUMNS = ("kind", "subject", "value", "limit_value", "fingerprint")


def _alert(rows: DataFrame, kind: str, subject: Column, value: Column, limit: Column, *parts: Column, more: tuple[str, ...] = ()) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"), limit.cast("double").alias("limit_value"),
                       alert_fingerprint(*parts).alias("fingerprint"), *more)


def _moment(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def use_without_surgery(lines: DataFrame, as_of: datetime, *more: str) -> DataFrame:
    c = F.col
    recent = lines.filter((c("ts") >= _moment(as_of - timedelta(hours=24))) & (c("ts") <= _moment(as_of)) & is_volatile(narrow=True))
    bare = recent.filter(~present(c("doctor")) | ~F.coalesce(c("duration_min") > 0, F.lit(False)))
    return _alert(bare, "no_surgery", F.concat_ws(" · ", "product", "case_no", "hospital"), c("qty"), F.lit(0.0), F.lit("sc"), c("case_no"), c("product_id"), fixed(c("qty")), more=more)


def below_reorder(plan: DataFrame, stock: DataFrame) -> DataFrame:
    """Keys the last run held to be healthy whose usable stock is now under the reorder point."""
    c = F.col
    usable = stock.groupBy(*KEYS).agg(F.sum("usable").alias("now"))
    rows = plan.filter((c("level") == "local") & (c("reorder_point") > 0) & c("criticality").isin("ok", "excess")).join(usable, KEYS).filter(c("now") < c("reorder_point"))
    half = (c("now") < c("reorder_point") * 0.5).cast("int")
    return _alert(rows, "below_reorder", F.concat_ws(" · ", "product", "location"), c("now"), c("reorder_point"), F.lit("ro"), c("product_id"), c("location"), half)


def late_deliveries(pending: DataFrame) -> DataFrame:
    c = F.col
    return _alert(pending.filter("late"), "late_delivery", F.concat_ws(" · ", c("ref"), c("product_id").cast("string")), c("qty"), F.lit(0.0), F.lit("et"), c("ref"), c("product_id"))


def extraordinary_load(schedule: DataFrame, lines: DataFrame, as_of: datetime, ratio: float = 1.5) -> DataFrame:
    c = F.col
    day = as_of.date()
    soon = schedule.filter((c("day") > F.lit(day)) & (c("day") <= F.lit(day + timedelta(days=3))))
    typical = typical_cases(lines.filter((c("ts") > _moment(as_of - timedelta(days=60))) & (c("ts") <= _moment(as_of))))
    rows = scheduled_load(soon, typical).filter(c("ratio") >= ratio)
    return _alert(rows, "extraordinary_load", c("hospital"), c("per_day"), c("typical"), F.lit("jx"), c("hospital"), c("first_day").cast("string"))


def undecided(proposals: DataFrame, as_of: datetime, valid_days: int = 7) -> DataFrame:
    """One alert a day when proposals wait about as long as they are valid."""
    c = F.col
    limit = max(2, valid_days - 2)
    old = proposals.filter(c("status").isin(*PENDING_STATES) & (c("created_at") <= _moment(as_of - timedelta(days=limit))))
    rows = old.agg(F.count("*").alias("n")).filter("n > 0")
    return _alert(rows, "undecided", F.concat(c("n").cast("string"), F.lit(" proposals")), c("n"), F.lit(limit), F.lit("ap"), c("n"), F.lit(as_of.date().isoformat()))


def all_alerts(lines: DataFrame, plan: DataFrame, stock: DataFrame, pending: DataFrame, schedule: DataFrame, proposals: DataFrame, as_of: datetime) -> DataFrame:
    parts = [use_without_surgery(lines, as_of), below_reorder(plan, stock), late_deliveries(pending), extraordinary_load(schedule, lines, as_of), undecided(proposals, as_of)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("fingerprint").agg(*[F.min(x).alias(x) for x in COLUMNS[:-1]])


ALERT = "kind string, subject string, value double, limit_value double, fingerprint string, raised_at timestamp"


def raise_once(alerts: DataFrame, keep_days: int = 90, delay: str = "7 days") -> DataFrame:
    """Of a stream of alerts (columns of `ALERT`) those whose fingerprint was not raised within the `keep_days` before.

    State is one moment per fingerprint, dropped by a timer once the watermark passes its end: work of a micro-batch grows with
    the batch, and state with the fingerprints of the last `keep_days`. An alert that is held back does not prolong the memory.
    Alerts later than `delay` behind the newest are dropped.
    """
    keep = keep_days * 86_400_000
    columns = [x.split()[0] for x in ALERT.split(", ")]

    def once(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first: dict[int, tuple] = {}  # the first alert of each day: a fingerprint that fires all the time costs one row a day
        for batch in batches:
            for row in batch.sort_values("moment").drop_duplicates("day").itertuples(index=False):
                if row.day not in first or row.moment < first[row.day].moment:
                    first[row.day] = row
        last, out = (state.get[0] if state.exists else None), []
        for _, row in sorted(first.items()):
            if last is None or row.moment > last + keep:
                out.append(row)
                last = row.moment
        state.update((last,))
        state.setTimeoutTimestamp(max(last + keep + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([[getattr(row, c) for c in columns] for row in out], columns=columns)

    moment = F.unix_millis("raised_at")
    timed = alerts.withWatermark("raised_at", delay).withColumns({"moment": moment, "day": F.floor(moment / 86_400_000)})
    return timed.groupBy("fingerprint").applyInPandasWithState(once, ALERT, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def start_alerts(alerts: DataFrame, path: str, checkpoint: str, keep_days: int = 90) -> StreamingQuery:
    """Append the alerts to raise to the table at `path`, by day; a restart goes on from the checkpoint and raises nothing twice."""
    rows = raise_once(alerts, keep_days).withColumn("raised_on", F.to_date("raised_at"))
    return rows.writeStream.format("parquet").partitionBy("raised_on").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def raise_alerts(alerts: DataFrame, root: str, as_of: datetime, keep_days: int = 90) -> DataFrame:
    """Hand a run's alerts to the stream of `root` and return those it raised for this moment.

    `root` holds what runs handed in, the state and what was raised. A run reads its own alerts and their state, not the past.
    """
    spark = alerts.sparkSession
    at = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    alerts.select(*COLUMNS).withColumn("raised_at", at).write.mode("append").parquet(f"{root}/inbox")
    start_alerts(spark.readStream.schema(ALERT).parquet(f"{root}/inbox"), f"{root}/raised", f"{root}/state", keep_days).awaitTermination()
    raised = spark.read.schema(f"{ALERT}, raised_on date").parquet(f"{root}/raised")
    return raised.filter((F.col("raised_on") == F.to_date(at)) & (F.col("raised_at") == at)).drop("raised_on")


def watch_lines(stream: DataFrame, path: str, checkpoint: str, as_of: datetime, keep_days: int = 90) -> StreamingQuery:
    """The first check on a stream of lines: each alert carries its line's time and is raised once."""
    checked = use_without_surgery(stream, as_of, "ts").withColumn("raised_at", F.col("ts").cast("timestamp")).drop("ts")
    return start_alerts(checked, path, checkpoint, keep_days)


def daily_usage_stream(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Daily quantity per product and hospital on the stream: the same buckets as the batch series, late lines within the delay."""
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp"))
    return timed.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 day"), "product_id", "hospital").agg(
        F.sum("qty").alias("qty"), F.count("*").alias("lines")).select(F.col("window.start").alias("day_start"), "product_id", "hospital", "qty", "lines")
