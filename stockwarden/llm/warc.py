"""WARC archives with one Zstandard dictionary.

The dictionary is built from a bounded sample of the records that will be archived. Each archive is a file: a skippable
frame (magic number 0x184D2A5D) that holds the dictionary, then every record as a frame of its own, so any record can be
read from its offset. The first record of each payload (smallest page_id) is a response, the others are revisits that
name it; both carry the digest and length of the full payload.

Every attempt of a task names its files differently, and the manifest, which Spark commits, names those of the attempts that count.
Readers know archives from the manifest alone: what a lost or second attempt leaves behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwarden.llm.common import hash_sample
from stockwarden.session import materialize, shared_dir

MAGIC = 0x184D2A5D
LEVEL = 3
#: The dictionary's size, and the records and bytes of each that it is built from.
DICTIONARY, SAMPLED, SAMPLE_BYTES = 1 << 15, 400, 1 << 14
#: Where the manifest stands in the folder of the archives.
MANIFEST = "_manifest"
#: An archive is closed when it has this many bytes.
ARCHIVE = 16 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{place if page is None else page}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, place: str) -> bytes:
    """A response record, or a revisit record without the payload if `refers_to` is given."""
    target = "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:none"
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, place)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if page is not None:
        head.append(f"WARC-Page-ID: {page}")
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, '')}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary; empty if there is too little to build one from (archives then have an empty first frame)."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=512, d=8, steps=1, threads=0).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def first_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def split_frames(archive: bytes):
    """(dictionary, iterator of records) of an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("an archive must begin with its dictionary's frame")
    dictionary, at = archive[8 : 8 + size], 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def records():
        rest = memoryview(archive)[at:]
        while len(rest):
            frame = reader.decompressobj()
            # The size that a frame states bounds what it holds; what follows it is the next frame.
            data = frame.decompress(rest[: 1 << 12])
            step = 1 << 12
            while not frame.eof:
                if step >= len(rest):
                    raise ValueError("an archive ends within a record")
                data += frame.decompress(rest[step : step + (1 << 16)])
                step = min(len(rest), step + (1 << 16))
            used = min(step, len(rest)) - len(frame.unused_data)
            yield data
            rest = rest[used:]

    return dictionary, records()


def parse(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes | None]:
    """(page_id, url, payload_bytes, digest, type, refers_to, payload or None) of a record; a payload must match its digest."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"the payload of page {fields.get('WARC-Page-ID')} isn't what its digest says")
    page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To-Page-ID")
    return (page and int(page), fields["WARC-Target-URI"], size, digest, kind, refers and int(refers), payload if kind == "response" else None)


_WRITTEN = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _writer(folder: str, dictionary):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        context, n, whole, held, count = TaskContext.get(), 0, [], 0, 0
        raw = dictionary.value
        shared = zstandard.ZstdCompressionDict(raw) if raw else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)

        def close():
            # No two attempts share a name; only what a committed task reports stands in the manifest.
            name = f"part-{context.partitionId():06d}-{n:04d}-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(b"".join([first_frame(raw), *whole]))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, count, held)], schema=_WRITTEN)

        for batch in batches:
            payloads = batch.column("payload")
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "row")), strict=True)
            for k, (page, url, sha, refers, row) in enumerate(rows):
                payload = (payloads[k].as_py() or "").encode("utf-8", "replace")
                digest = base64.b32encode(bytes.fromhex(sha)).decode().rstrip("=")
                frame = compressor.compress(record(page, url, payload, digest, refers, str(row)))
                whole.append(frame)
                held, count = held + len(frame), count + 1
                if held >= ARCHIVE:
                    yield close()
                    n, whole, held, count = n + 1, [], 0, 0
        if whole:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html) to `folder`; returns (archive, records, bytes).

    A null html is an empty payload. Of equal payloads of at least `least` bytes the smallest page_id is the response; rows
    that repeat that id, and rows with equal payloads and no id at all, are responses too. No pages give no archives.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    shared = keyed.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that its exact size decides whether it is broadcast; large or skewed, it is joined by digest.
    shared = materialize(shared.select(F.col("digest").alias("of"), "first"), "warc-shared")
    sample = keyed.select("page_id", "url", "digest", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))
    drawn = hash_sample(sample, pages.count(), SAMPLED, "page_id", "digest").collect()  # `SAMPLED` rows of `SAMPLE_BYTES` characters at most
    # The sample is built from whole records, but long payloads add their beginning only.
    records = [record(r.page_id, r.url, r.payload.encode("utf-8", "replace"), digest_of(r.digest.encode()), None, "") for r in drawn]
    dictionary = spark.sparkContext.broadcast(build_dictionary(records))
    met = keyed if shared.isEmpty() else keyed.join(shared, F.col("digest") == F.col("of"), "left")
    refers = F.lit(None).cast("long") if met is keyed else F.when(F.col("page_id") != F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))
    rows = met.select(F.col("page_id").cast("long").alias("page_id"), "url", "payload", "digest", refers.cast("long").alias("refers_to"), F.monotonically_increasing_id().alias("row"))
    _make(folder)
    rows.mapInArrow(_writer(folder, dictionary), "archive string, records long, bytes long").write.parquet(f"{folder}/{MANIFEST}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that were written whole: (archive, records, bytes). Files of lost attempts are not among them."""
    return spark.read.schema("archive string, records long, bytes long").parquet(f"{folder}/{MANIFEST}")


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as a URI; without a scheme it belongs to the cluster's default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/+", "file:///", whole)


def _make(folder: str) -> None:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives that the manifest of `folder` names: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as archive:
                    content = archive.read()
                rows = []
                for data in split_frames(content)[1]:
                    row = parse(data)
                    rows.append(row if payloads else (*row[:-1], None))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    names = manifest(spark, folder).select("archive")
    # One row is one archive: without a count of its own, all of these few bytes would go to one task.
    parts = max(1, min(names.count(), 8 * spark.sparkContext.defaultParallelism))
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return names.repartition(parts, "archive").mapInArrow(run, kinds)


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)], schema=_READ)


def archived(pages: DataFrame) -> DataFrame:
    """Archive `pages` in a new folder of the shared place and read the archives back, without the payloads."""
    spark = pages.sparkSession
    folder = f"{qualified(spark, shared_dir(spark))}/warc-{uuid.uuid4().hex}"
    written = write_archives(pages, folder)
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long").select("*")
    return read_archives(spark, folder, payloads=False).drop("payload")
