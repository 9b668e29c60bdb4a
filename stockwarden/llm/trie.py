"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Conversations share their first turns with the first conversation of their family. Every rebuilt conversation is a sequence
of turns; a sequence is known by its length and 128 bits of position-dependent turn hashes joined by exclusive or, so the
key of a prefix is a running aggregate and the key of a whole sequence a plain one.

1. Equal sequences collapse to one weighted sequence (its smallest conversation, its weight, the list of ends). From here
   on copies cost nothing.
2. A sequence that is a proper prefix of another is no leaf: an anti-join with the proper prefixes leaves the leaves.
3. Weighted prefixes are summed to nodes. A node belongs to the sequence of its smallest member, which therefore owns an
   unbroken lower stretch of its own path: what nodes add to their ancestors is a running sum along each sequence, and the
   sums over a subtree are a second grouping of the same prefixes. Nothing pairs nodes with their ancestors.

Lists of ends are cut into runs of conversation ids of bounded width; a list of several runs is hashed as a stream.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.llm.common import WORD
from stockwarden.session import materialize

FAMILY, HEADS = 20, 4
#: Conversation ids of one run of an end list span at most this many numbers.
RUN = 1 << 16
KEY = ("one", "two", "depth")


def _turn(place, a, b, words):
    """A turn at a place: the two halves of its hash, and its words."""
    return F.struct(place.cast("long").alias("depth"), F.xxhash64(place, a, b).alias("one"), F.xxhash64(b, place, a).alias("two"), words.alias("words"))


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Turns of the rebuilt conversations: conv_id, depth (from 1; a row of depth 0 for every conversation), one, two, words.

    Rows with a null conv_id belong to no conversation. A null role or text is empty, a null turn comes first, equal turns
    follow role and text, and repeated rows are turns of their own.
    """
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string")) % heads
    turns = conversations.where("conv_id is not null").select(
        c.cast("long").alias("conv_id"), (c - c % family).cast("long").alias("family"), F.col("turn"),
        *(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("role", "text")))
    order = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    hashes = (F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(heads), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    first = turns.where("conv_id = family").withColumn("place", F.row_number().over(order)).where(F.col("place") < heads)
    first = first.select("family", F.struct("place", *hashes).alias("turn")).groupBy("family").agg(F.array_sort(F.collect_list("turn")).alias("lead"))
    placed = turns.join(first, "family", "left").withColumn("place", F.row_number().over(order))
    placed = placed.select("conv_id", "place", F.coalesce("lead", F.array().cast(first.schema["lead"].dataType)).alias("lead"), h.cast("int").alias("h"), *hashes)
    none = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).cast("long").alias("words")))
    given = F.transform(F.slice("lead", F.lit(1), F.col("h")), lambda t: _turn(t["place"], t["a"], t["b"], t["words"]))
    own = F.array(_turn(F.least("h", F.size("lead")) + F.col("place") - F.col("h"), F.col("a"), F.col("b"), F.col("words")))
    start = F.when(F.col("place") == 1, F.concat(none, given)).otherwise(F.slice(none, 1, 0))
    rest = F.when(F.col("place") > F.col("h"), own).otherwise(F.slice(none, 1, 0))
    return placed.select("conv_id", F.explode(F.concat(start, rest)).alias("t")).select("conv_id", "t.*")


def _stream_digests(batches):
    """SHA-256 of the joined runs of each sequence; rows come sorted by sequence and run."""
    key, state = None, None

    def out():
        columns = [pa.array([k], pa.int64()) for k in key]
        return pa.RecordBatch.from_arrays([*columns, pa.array([state.hexdigest()])], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *own, text in zip(*(batch.column(n).to_pylist() for n in (*KEY, "text")), strict=True):
            if own != key:
                if key is not None:
                    yield out()
                key, state = own, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if key is not None:
        yield out()


def end_digests(ended: DataFrame, run: int = RUN) -> DataFrame:
    """SHA-256 of the ascending conversation ids of each sequence, from (conv_id, one, two, depth): one, two, depth, ends_sha256."""
    runs = ended.groupBy(*KEY, F.floor(F.col("conv_id") / run).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("text"))
    runs = materialize(runs, "trie-ends")
    counted = runs.groupBy(*KEY).agg(F.count("*").alias("runs"), F.min("text").alias("text"))
    short = counted.where("runs = 1").select(*KEY, F.sha2("text", 256).alias("ends_sha256"))
    long = runs.join(counted.where("runs > 1").select(*KEY), list(KEY), "leftsemi").repartition(*KEY).sortWithinPartitions(*KEY, "run")
    return short.unionByName(long.select(*KEY, "text").mapInArrow(_stream_digests, "one long, two long, depth long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, run: int = RUN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `conv_id` is the node's smallest member. An empty table has no node; conversations left without a turn end at the root.
    Odd rows are treated as `rebuilt` says; columns beyond conv_id, turn, role and text are not read.
    """
    turns = materialize(rebuilt(conversations, family, heads), "trie-turns")
    ended = materialize(turns.groupBy("conv_id").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), F.max("depth").alias("depth")), "trie-sequences")
    whole = ended.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"))
    whole = materialize(whole.withColumnRenamed("depth", "length").select("conv_id", "one", "two", "length", "weight"), "trie-whole")

    down = Window.partitionBy("conv_id").orderBy("depth")
    path = turns.join(whole.select("conv_id", "length", "weight"), "conv_id")
    path = path.select("conv_id", "depth", "length", "weight", "words", F.bit_xor("one").over(down).alias("one"), F.bit_xor("two").over(down).alias("two"))
    path = materialize(path, "trie-prefixes")

    proper = path.where("depth < length").select(*KEY).distinct()
    leaves = whole.withColumnRenamed("length", "depth").join(proper, list(KEY), "leftanti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    path = path.join(leaves, "conv_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0).cast("long")))
    nodes = path.groupBy(*KEY).agg(F.min("conv_id").alias("top"), F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.max("words").alias("words"))
    nodes = materialize(nodes, "trie-nodes")

    met = path.select("conv_id", *KEY).join(nodes, list(KEY))
    owned = F.col("conv_id") == F.col("top")
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    along = met.select(
        *KEY, "top", "n_convs", "n_leaves",
        F.sum(F.when(owned, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(up).alias("saved"),
        F.lag(owned.cast("long"), 1, 0).over(up).alias("child"),
        F.lead("top").over(up).alias("parent"))
    summed = along.groupBy(*KEY, "top", "n_convs", "n_leaves").agg(
        F.min("parent").alias("parent_conv_id"), F.sum("child").alias("n_children"), F.sum("saved").cast("long").alias("saved_tokens"))
    out = summed.join(end_digests(ended, run), list(KEY), "left")
    return out.select(
        F.col("top").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE_SQL = r"""
WITH h AS (
  SELECT c.conv_id, conv_id - conv_id % 20 AS family, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)),
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT h.conv_id, 0 AS part, b.place, b.role, b.text FROM h JOIN t b ON b.conv_id = h.family AND b.place <= h.h
  UNION ALL SELECT h.conv_id, 1, t.place, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.place > h.h),
s AS (
  SELECT h.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.part, r.place) FILTER (WHERE r.part IS NOT NULL), []) AS turns
  FROM h LEFT JOIN r ON r.conv_id = h.conv_id GROUP BY h.conv_id),
p AS (SELECT conv_id, turns, len(turns) AS length, unnest(range(0, len(turns) + 1)) AS depth FROM s),
k AS (SELECT conv_id, length, depth, CAST(turns[1:depth] AS VARCHAR) AS node, CAST(turns[1:depth - 1] AS VARCHAR) AS parent, turns[depth].text AS last FROM p),
n AS (
  SELECT node, depth, min(CASE WHEN depth > 0 THEN parent END) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(min(last), '[^\x20\x09-\x0D]+')) END AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
  FROM k GROUP BY node, depth),
c AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.node AND x.depth = n.depth + 1) AS n_children FROM n),
below AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, b.node, b.depth FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
u AS (
  SELECT top, top_depth, sum(c.saved) AS saved_tokens, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves
  FROM below JOIN c ON c.node = below.node AND c.depth = below.depth GROUP BY top, top_depth)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, u.n_leaves,
  CAST(u.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM c JOIN u ON u.top = c.node AND u.top_depth = c.depth LEFT JOIN n q ON q.node = c.parent AND q.depth = c.depth - 1
"""
