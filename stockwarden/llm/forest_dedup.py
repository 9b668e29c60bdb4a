"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits all vectors at each level along a random direction near the median of the node; vectors closer to the
cut than `SPILL` go to both sides. Vectors are compared (cosine in double precision, equal labels only) within leaves
only. Two unit vectors with cosine 0.98 differ by 0.025 in a random direction of 64 dimensions, so a tree parts few of
them, and only pairs that every one of the trees parts are missed.

The cuts are fitted on at most `SAMPLE` vectors (a hash sample, documented bound); nodes too thin in the sample are cut at
the sample's median of the direction, so the depth follows the number of vectors. Every vector is routed. A leaf with
more than `BLOCK` vectors is compared in blocks against blocks, each a task of its own, so dense clusters stay bounded.

A pair may share leaves of several trees. It is counted where its first common leaf is; each vector carries its leaves, so
that is decided on the spot, and no pair is ever written. Of the links of a comparison, each vector keeps one to the first
vector of its component there, so all comparisons together connect what any of them linked. Equal vectors are reduced to one with a count of copies first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.llm.common import hash_sample
from stockwarden.llm.components import components
from stockwarden.session import materialize

SIMILARITY = 0.98
TREES, SPILL = 10, 0.02
LEAF, BLOCK, SAMPLE, THIN = 768, 2048, 40_000, 24
PAIRS = 1 << 20


def valid(vector: str) -> F.Column:
    """True for vectors that take part: no null or non-finite component, not all zero, not null."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision, safe from overflow of squares."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Forest:
    """Directions by tree and level; cuts by node where the sample is dense, by level below."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 7):
        self.depth, self.trees, self.spill = depth, trees, spill
        draw = np.random.default_rng(seed).standard_normal((trees, depth, sample.shape[1]))
        self.directions = draw / np.linalg.norm(draw, axis=2, keepdims=True)
        self.cuts: list[list[np.ndarray]] = []
        for t in range(trees):
            sides, node, cuts = sample @ self.directions[t].T, np.zeros(len(sample), np.int64), []
            for level in range(depth):
                p = sides[:, level]
                middle = float(np.median(p)) if len(p) else 0.0
                if len(sample) < THIN << level:
                    cuts.append(np.array([middle]))
                    continue
                order = np.lexsort((p, node))
                edge = np.searchsorted(node[order], np.arange((1 << level) + 1))
                size = np.diff(edge)
                at = np.minimum(edge[:-1] + size // 2, len(p) - 1)
                cut = np.where(size >= THIN // 2, p[order][at], middle)
                cuts.append(cut)
                node = 2 * node + (p > cut[node])
            self.cuts.append(cuts)

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every row; leaf numbers differ between trees."""
        out_row, out_leaf = [], []
        for t in range(self.trees):
            sides = rows @ self.directions[t].T
            row, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                cut = self.cuts[t][level]
                gap = sides[row, level] - (cut[node] if len(cut) > 1 or level == 0 else cut[0])
                left, right = gap <= self.spill, gap > -self.spill
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            out_row.append(row)
            out_leaf.append(node + (t << 40))
        return np.concatenate(out_row), np.concatenate(out_leaf)


def matrix(column, width: int) -> np.ndarray:
    """A list column as doubles (rows x width)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _router(forest, width: int, kind: str):
    number = pa.float32() if kind == "float" else pa.float64()
    schema = pa.schema([("id", pa.int64()), ("copies", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(number)), ("leaf", pa.int64()), ("leaves", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            row, leaf = forest.value.leaves(unit(matrix(batch.column("vector"), width)))
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf))
            for at in range(0, len(row), 4096):
                part = pa.array(row[at : at + 4096])
                columns = [batch.column(c).take(part) for c in ("id", "copies", "label", "vector")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(leaf[at : at + 4096]), lists.take(part)], schema=schema)

    return run


_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("joined", pa.int64())])


def _met_before(lists_i: np.ndarray, lists_j: np.ndarray) -> np.ndarray:
    """Whether two rows of padded leaf lists (fillers differ) share an element."""
    out = np.zeros(len(lists_i), bool)
    for k in range(lists_i.shape[1]):
        out |= (lists_i[:, k : k + 1] == lists_j).any(axis=1)
    return out


def joined_by(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (the least row of each component) after the links (i, j) are added to those of `label`."""
    i, j = label[i], label[j]
    while (apart := i != j).any():
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))  # only roots move, so no earlier link is cut
        while ((up := label[label]) != label).any():
            label = up
        i, j = label[i], label[j]
    return label


def _comparer(width: int, similarity: float):
    def run(key, group):
        leaf, first, second = (k.as_py() for k in key)
        ids, copies, label, block = (group[c].to_numpy() for c in ("id", "copies", "label", "block"))
        rows = unit(matrix(group["vector"], width))
        lists = group["leaves"].combine_chunks()
        ends, flat = np.asarray(lists.offsets) - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(ends))
        use = flat < leaf  # leaves where a pair would have been counted already
        owner, flat = owner[use], flat[use]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        earlier = np.full((len(ids), int(place.max()) + 1 if len(place) else 0), -1, np.int64)
        earlier[owner, place] = flat
        links, label_of = np.zeros(len(ids), np.int64), np.arange(len(ids))
        order = np.lexsort((block, label))
        for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            one, two = part[block[part] == first], part[block[part] == second]
            step = max(1, PAIRS // max(1, len(two)))
            for at in range(0, len(one), step):
                some = one[at : at + step]
                i, j = np.nonzero(rows[some] @ rows[two].T >= similarity)
                i, j = some[i], two[j]
                if first == second:
                    i, j = i[i < j], j[i < j]
                if earlier.shape[1] and len(i):
                    other = np.where(earlier == -1, -2, earlier)
                    new = np.concatenate([~_met_before(earlier[i[s : s + PAIRS]], other[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)])
                    i, j = i[new], j[new]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                label_of = joined_by(label_of, i, j)
        seen = links > 0
        return pa.Table.from_arrays([pa.array(x[seen]) for x in (ids, links, ids[label_of])], schema=_FOUND)

    return run


def near_vectors(
    vectors: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, spill: float = SPILL, sample: int = SAMPLE, leaf: int = LEAF
) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Links join vectors with equal labels and cosine >= `similarity`. Vectors that are null, zero, or hold null or
    non-finite components, and rows with a null label or id, link with nothing (n_links 0, component_id = vec_id). Vectors
    of another length than the first valid one by vec_id are refused. Repeated rows are vectors of their own: they link
    with each other. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    usable = valid("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = materialize(vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vector"), F.col("label").cast("long").alias("label"), usable.alias("usable")), "forest-rows")
    apart = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    reps = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    # An id that stands for several texts of a label would join them; a number of its own keeps representatives apart.
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "forest-vectors")
    sizes = reps.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    n, width = sizes["n"], sizes["high"]
    if not n:
        return apart
    if sizes["low"] != width:
        raise ValueError(f"vectors of {sizes['low']} and of {width} components can't be compared")
    drawn = hash_sample(reps, n, sample, "id", "rep").select("vector").toPandas()  # at most `sample` vectors
    depth = max(1, math.ceil(math.log2(max(1, n / leaf)))) if n > leaf else 0
    forest = spark.sparkContext.broadcast(Forest(unit(np.stack(drawn["vector"].to_numpy()).astype(np.float64)), depth, trees if depth else 1, spill))
    routes = f"id long, copies long, label long, vector array<{kind}>, leaf long, leaves array<long>"
    routed = materialize(reps.select(F.col("rep").alias("id"), "copies", "label", "vector").mapInArrow(_router(forest, width, kind), routes), "forest-leaves")
    blocks = routed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    met = routed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    found = met.select("leaf", "first", "second", "id", "copies", "label", "vector", "leaves", "block").groupBy("leaf", "first", "second")
    found = materialize(found.applyInArrow(_comparer(width, similarity), "id long, links long, joined long"), "forest-links")
    # Representatives are numbered by place; components are named by their smallest vec_id afterwards.
    roots = components(found.select(F.col("id").alias("a"), F.col("joined").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    known = reps.join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = materialize(known.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "forest-classes")
    named = known.groupBy("root").agg(F.min("id").alias("component_id"))
    out = rows.where("usable").join(known.join(named, "root").select("label", "vector", "n_links", "component_id"), ["label", "vector"])
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(apart)


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT x, x AS y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT e.vec_id, CAST((SELECT COUNT(*) FROM links WHERE x = e.vec_id) AS BIGINT) AS n_links,
       COALESCE((SELECT MIN(y) FROM reach WHERE x = e.vec_id), e.vec_id) AS component_id,
       COALESCE((SELECT MIN(y) FROM reach WHERE x = e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
