"""Incremental snapshot: a change stream merged by key, equal to a full read at every point."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockwarden.streaming.versioned import ROWS_PER_BUCKET, merge

def start_snapshot(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> StreamingQuery:
    """Merge all available changes into the versioned table at `path`; restarting continues from the checkpoint.

    The checkpoint names the source, so a batch that is replayed after a failure is not merged twice.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, number: merge(batch, path, key, order, rows_per_bucket, checkpoint, number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def forget(rows: DataFrame, seen: str, as_of: datetime, days: int = 120) -> DataFrame:
    """Rows some run needed within the last `days`."""
    limit = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return rows.filter(F.col(seen) >= limit)


def changed_since(rows: DataFrame, stored: DataFrame, key: str, written: str, synced: datetime, margin_seconds: int = 120) -> DataFrame:
    """Ids to read again: those not stored, and those written since the last sync (with a safety margin) under another time."""
    since = F.lit(synced.isoformat(sep=" ")).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(margin_seconds).cast("decimal(18,6)"))
    known = stored.select(key, F.col(written).alias("_stored"))
    both = rows.join(known, key, "left")
    state = F.when(F.col("_stored").isNull(), "new").when((F.col(written) >= since) & (F.col(written) != F.col("_stored")), "changed")
    return both.withColumn("reason", state).filter(F.col("reason").isNotNull()).drop("_stored")


def dropped(current: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored ids the source no longer returns."""
    return stored.join(current.select(key), key, "left_anti")
