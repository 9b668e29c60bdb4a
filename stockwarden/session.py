"""Session settings and the one way lineage is cut: a Parquet table in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Only for local test sessions that name no shared folder: application id -> folder.
_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "stockwarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. Shuffle partitions stay adaptive: AQE coalesces and splits them."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A cluster names it; only an unset session gets its own."""
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY, None)
    if path:
        return path
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    return _LOCAL_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="stockwarden-"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at `path` in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def release(spark: SparkSession) -> None:
    """Have the files of shuffles deleted that no plan refers to any more.

    Spark does so for what the driver's garbage collection finds, which on its own may take half an hour.
    """
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` once and read it back.

    The result survives lost executors, and its file size is exact, so the planner broadcasts it only when it
    really is below `spark.sql.autoBroadcastJoinThreshold` and shuffles it otherwise. The shuffles of writes are of no
    more use, so their files go, those of the last write as a rule with the next.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)
