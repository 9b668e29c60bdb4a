"""A keyed table in versions: a merge writes new files and then publishes one small manifest.

Rows are dealt over buckets by linear hashing: with n buckets a key's place needs only n, and the table grows by splitting one
bucket at a time, so a bucket stays near `rows_per_bucket` rows at every size of the table. A merge reads and writes the buckets
its batch touches and those that split, nothing else.

A version is a manifest (`_versions/<number>.json`) that lists the folder of every bucket. Publishing it is one rename that
fails if the number is taken: readers see a whole version or the one before, a merge that dies leaves files nobody names, and
of two merges at once one fails. Files of old versions stay until `expire` removes them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from stockwarden.session import materialize

ROWS_PER_BUCKET = 2_000_000


class Conflict(RuntimeError):
    """Another merge published the version this one was about to publish."""


@dataclass
class Version:
    number: int = 0
    key: str = ""
    schema: str = ""
    #: Folder (or none) and rows of every bucket.
    buckets: list[tuple[str | None, int]] = field(default_factory=lambda: [(None, 0)])
    #: The last batch merged from each source: a replayed batch is recognised.
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.buckets)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    place, files = _files(spark, f"{path}/_versions")
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A published version (the newest by default); an empty one where there is none."""
    known = versions(spark, path)
    if number is None and not known:
        return Version()
    place, files = _files(spark, f"{path}/_versions/{known[-1] if number is None else number:012d}.json")
    stream = files.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    read = json.loads(text)
    return Version(**read | {"buckets": [tuple(b) for b in read["buckets"]]})


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version visible, or raise `Conflict` where its number is taken."""
    place, files = _files(spark, f"{path}/_versions/{version.number:012d}.json")
    aside, _ = _files(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(asdict(version)).encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(place), options)  # never replaces
    except Exception as failed:
        files.delete(aside, False)
        if files.exists(place):
            raise Conflict(f"version {version.number} of {path} is taken") from failed
        raise


def bucket_of(key: str, n: int) -> Column:
    """The bucket of a key among `n`: by the next power of two, or by half of it for a bucket that is not there yet."""
    low = 1 << (n.bit_length() - 1)
    h = F.pmod(F.xxhash64(key), F.lit(2 * low))
    return F.when(h < n, h).otherwise(h - low).cast("int")


def ancestor(bucket: int, n: int) -> int:
    """The bucket that held a bucket's rows when there were `n`."""
    while bucket >= n:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def _read(spark: SparkSession, path: str, version: Version, wanted) -> DataFrame:
    folders = [f"{path}/data/{version.buckets[b][0]}/bucket={b}" for b in sorted(wanted) if version.buckets[b][0]]
    schema = StructType.fromJson(json.loads(version.schema))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """All rows of a version, the newest by default."""
    version = load(spark, path, number)
    if not version.schema:
        raise FileNotFoundError(f"no version at {path}")
    return _read(spark, path, version, range(len(version.buckets)))


def _commit(spark: SparkSession, path: str, old: Version, rows: DataFrame, n: int, written: set[int], schema: str, key: str, batches: dict[str, int]) -> Version:
    """Write `rows` as the whole content of the buckets `written` among `n`, and publish."""
    folder = uuid.uuid4().hex
    rows.write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
    counted = spark.read.schema(StructType.fromJson(json.loads(schema)).add("bucket", IntegerType())).parquet(f"{path}/data/{folder}").groupBy("bucket").count()
    held = {r["bucket"]: r["count"] for r in counted.collect()}  # one row per bucket written
    buckets = [((folder, held[b]) if b in held else (None, 0)) if b in written else old.buckets[b] for b in range(n)]
    version = Version(old.number + 1, key, schema, buckets, batches)
    publish(spark, path, version)
    return version


def newest(rows: DataFrame, key: str, order: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: the newest by the order columns, reduced map-side."""
    others = [c for c in rows.columns if c != key and c not in within]
    return rows.groupBy(*within, key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("v")).select(*within, key, *[F.col(f"v.{c}").alias(c) for c in others])


def merge(batch: DataFrame, path: str, key: str, order: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, source: str = "", batch_id: int | None = None) -> Version:
    """Merge a batch by key, the newest row of each winning; returns the version that holds it.

    A batch known by (`source`, `batch_id`) is merged once however often it comes. A row with a null key is one key like any other.
    """
    spark = batch.sparkSession
    old = load(spark, path)
    if batch_id is not None and old.batches.get(source, -1) >= batch_id:
        return old
    fresh = materialize(newest(batch, key, order), "merge-batch")
    arrived, before = fresh.count(), len(old.buckets)
    if not arrived:
        return old
    n = max(before, -(-(old.rows + arrived) // rows_per_bucket))
    touched = [r[0] for r in fresh.select(bucket_of(key, n).alias("b")).distinct().collect()]  # at most one number per bucket
    opened = {ancestor(b, before) for b in (*touched, *range(before, n))}
    written = {b for b in range(n) if ancestor(b, before) in opened}
    schema = old.schema or fresh.schema.json()
    stored = _read(spark, path, old, opened) if old.schema else fresh.limit(0)
    rows = stored.unionByName(fresh.select(*stored.columns)).withColumn("bucket", bucket_of(key, n)).repartition(len(written), "bucket")
    batches = old.batches | ({source: batch_id} if batch_id is not None else {})
    return _commit(spark, path, old, newest(rows, key, order, ("bucket",)), n, written, schema, key, batches)


def prune(spark: SparkSession, path: str, keep: Column) -> Version:
    """A version without the rows for which `keep` is not true; only buckets that lose a row are written."""
    old = load(spark, path)
    n = len(old.buckets)
    if not old.schema:
        return old
    rows = _read(spark, path, old, range(n)).withColumn("bucket", bucket_of(old.key, n))
    kept = F.coalesce(keep, F.lit(False))
    losing = {r[0] for r in rows.filter(~kept).select("bucket").distinct().collect()}
    if not losing:
        return old
    left = _read(spark, path, old, losing).filter(kept).withColumn("bucket", bucket_of(old.key, n)).repartition(len(losing), "bucket")
    return _commit(spark, path, old, left, n, losing, old.schema, old.key, old.batches)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all but the newest `keep` versions and the files only they name; returns how many folders went.

    Folders newer than the oldest version kept stay: a merge that has not published yet may be writing them.
    """
    known = versions(spark, path)
    gone, kept = known[:-keep], known[-keep:]
    if not kept:
        return 0
    place, files = _files(spark, f"{path}/_versions/{kept[0]:012d}.json")
    since = files.getFileStatus(place).getModificationTime()
    named = {folder for number in kept for folder, _ in load(spark, path, number).buckets if folder}
    for number in gone:
        files.delete(_files(spark, f"{path}/_versions/{number:012d}.json")[0], False)
    data, _ = _files(spark, f"{path}/data")
    old = [s.getPath() for s in files.listStatus(data) if s.getPath().getName() not in named and s.getModificationTime() < since]
    for folder in old:
        files.delete(folder, True)
    return len(old)
