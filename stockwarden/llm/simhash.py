"""Near duplicates by SimHash fingerprints, with pivot distance tables.

Fingerprint: XXH64 of each three-word shingle votes on 64 bits. Two fingerprints link at `BITS` or fewer differing bits.

Finding the links. The Hamming distances of every fingerprint to many fixed reference fingerprints (pivots) are computed
once. By the triangle inequality two fingerprints at distance d differ by at most d in every coordinate of that table, so
a pair whose largest coordinate difference exceeds 2 is discarded without looking at it again; the survivors are
verified bit by bit. To bring pairs together without comparing everything, the same table is kept for parts of the
fingerprint: of four parts, two differing bits leave at least two untouched, and there all distances to the pivots are
equal. Fingerprints therefore meet under the six pairs of parts, keyed by the coordinates of those parts. A bucket with
too many members is split again by its remaining bits in the same way (32 bits, then 16, then 8 are left), so that no
bucket stays large and no link is lost. Nothing is emitted per pair: a bucket yields links to its smallest members only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from stockwarden.llm.common import fresh, giving_back, mix64, values_of, word_bounds, words_of
from stockwarden.llm.components import components
from stockwarden.session import materialize

SEED, SHINGLE, BITS = 42, 3, 2
PIVOTS = 16
PARTS = 4
#: Members of a bucket that one task compares; larger ones are split by their other bits.
BUCKET = 512
CHUNK = 1 << 16

_PIVOT_BITS = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64), 7)
_WEIGHTS = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64), 11) | np.uint64(1)


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of one text; 0 if it is null or has no word."""
    words = words_of(text)
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    if len(words) <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        starts, ends = word_bounds(joined)
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches):
    for texts in batches:
        yield pa.array(np.fromiter(map(fingerprint_of, values_of(texts)), np.uint64, len(texts)).view(np.int64))


@arrow_udf(LongType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The fingerprint's 64 bits as a signed number."""
    yield from giving_back(_fingerprints)(batches)


def pivot_distances(values: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Hamming distances (rows x pivots) of fingerprints to the pivots, within the bits of `mask` if given."""
    apart = values[:, None] ^ _PIVOT_BITS[None, :]
    return np.bitwise_count(apart if mask is None else apart & mask[:, None])


def _parts(free: np.ndarray) -> list[np.ndarray]:
    """The free bits of each row cut into `PARTS` masks of equal size, lowest bits first."""
    total = np.bitwise_count(free).astype(np.int64)
    bits = (free[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1)
    rank = np.cumsum(bits, axis=1).astype(np.int64) - 1
    part = rank * PARTS // np.maximum(total, 1)[:, None]
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return [((bits.astype(bool) & (part == p)) * powers[None, :]).sum(axis=1, dtype=np.uint64) for p in range(PARTS)]


_KEYS = pa.schema([("bucket", pa.int64()), ("free", pa.int64()), ("fp", pa.int64())])


def _key_rows(batches):
    """From (bucket, free, fp): the rows of the next level, one for each choice of parts that may be untouched."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, free, fp = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("bucket", "free", "fp"))
        masks = _parts(free)
        with np.errstate(over="ignore"):
            codes = [(pivot_distances(fp, m).astype(np.uint64) * _WEIGHTS[None, :]).sum(axis=1, dtype=np.uint64) for m in masks]
            for n, (p, q) in enumerate(combinations(range(PARTS), PARTS - BITS)):
                key = mix64(mix64(codes[p], 1) + mix64(codes[q], 2) + mix64(bucket, n + 3))
                rest = free & ~(masks[p] | masks[q])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, rest, fp)], schema=_KEYS)


def close_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of fingerprints within `BITS`: pivot table first, bits last."""
    rows = pivot_distances(fp).astype(np.int16)
    order = np.argsort(rows[:, 0], kind="stable")
    first = rows[order, 0]
    upto = np.searchsorted(first, first + BITS, side="right")
    left, right = [], []
    for k in range(len(fp)):
        others = order[k + 1 : upto[k]]
        for pivot in range(1, PIVOTS):
            if not len(others):
                break
            others = others[np.abs(rows[others, pivot] - rows[order[k], pivot]) <= BITS]
        others = others[np.bitwise_count(fp[others] ^ fp[order[k]]) <= BITS]
        left.append(np.full(len(others), order[k]))
        right.append(others)
    i, j = np.concatenate(left), np.concatenate(right)
    return np.minimum(i, j), np.maximum(i, j)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_rows(batches):
    """From lists of fingerprints: enough links to connect what is close within each list."""
    for batch in batches:
        lists = batch.column("fps")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.offsets)
        ends = ends - ends[0]
        size = np.diff(ends)
        a, b = [], []
        twos = ends[:-1][size == 2]
        if len(twos):  # most buckets: compare them all at once
            x, y = flat[twos], flat[twos + 1]
            tables = np.abs(pivot_distances(x).astype(np.int16) - pivot_distances(y).astype(np.int16)).max(axis=1) <= BITS
            x, y = x[tables], y[tables]
            near = np.bitwise_count(x ^ y) <= BITS
            a.append(x[near])
            b.append(y[near])
        for k in np.flatnonzero(size > 2):
            own = flat[ends[k] : ends[k + 1]]
            i, j = close_pairs(own)
            label = np.arange(len(own))
            while len(i):
                low = np.minimum(label[i], label[j])
                new = label.copy()
                np.minimum.at(new, i, low)
                np.minimum.at(new, j, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(own)))
            a.append(own[moved])
            b.append(own[label[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=_LINKS)


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) within `BITS` of one another."""
    spark = fps.sparkSession
    level = fps.select(F.lit(0).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("free"), "fp")
    found = spark.createDataFrame([], "a long, b long")
    for depth in range(4):
        keyed = materialize(level.mapInArrow(giving_back(_key_rows), "bucket long, free long, fp long"), "simhash-keys")
        counts = materialize(keyed.groupBy("bucket").count().where("count > 1"), "simhash-buckets")
        crowded = counts.where(F.col("count") > BUCKET) if depth < 3 else counts.where("false")
        small = counts if depth == 3 else counts.where(F.col("count") <= BUCKET)
        lists = keyed.join(small.select("bucket"), "bucket").groupBy("bucket").agg(F.collect_list("fp").alias("fps"))
        found = found.unionByName(lists.select("fps").mapInArrow(giving_back(_link_rows), "a long, b long"))
        if crowded.isEmpty():
            break
        level = keyed.join(crowded.select("bucket"), "bucket")
    return found


def classes(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints of column fp; fingerprints without a link are their own root."""
    own = fps.select("fp").distinct()
    roots = components(links(own))
    return own.join(roots, own.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Null and empty texts have fingerprint zero and link like any other. component_id is the smallest non-null doc_id of the
    component (null if there is none). Rows with a null or repeated doc_id each give a row. Other columns are ignored.
    """
    docs = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    own = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints-distinct")
    named = own.join(classes(own), "fp")
    named = materialize(named.select("fp", "root", "least"), "fingerprint-classes")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(first, "root").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each near-duplicate group: the smallest doc_id (null last; of repeated rows one). Columns stay.

    Rows are known by a hash of id and text, so no copy of the texts is stored; they are shuffled once.
    """
    key, kept_key = fresh(docs, "key"), fresh(docs, "kept_key")
    keyed = F.xxhash64(F.col(doc_id), F.col(text))
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), keyed.alias("key"), fingerprint(F.col(text)).alias("fp")), "simhash-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")
    own = materialize(rows.groupBy("fp").agg(F.min(rank).alias("first")), "fingerprints-distinct")
    kept = own.join(classes(own), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(kept_key))
    kept = materialize(kept, "simhash-kept")
    met = docs.withColumn(key, keyed).join(kept, F.col(key) == F.col(kept_key), "left_semi")
    return met.dropDuplicates([key, doc_id]).drop(key)
