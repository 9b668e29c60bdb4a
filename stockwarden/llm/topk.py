"""Exact top-k inner products with a three-phase uniform threshold.

Vectors are whole numbers. A score is the sum of `LISTS` partial scores, one for each run of components: every query has
that many score lists over all candidates, kept where the candidates are.

1. Every block of candidates gathers, for each query and list, its best partial scores; the exact scores of what stands in
   these short lists give each query a lower bound on its k-th best score.
2. That bound goes back to the blocks with the query. A candidate that reaches it must have a partial score of at least
   bound / `LISTS` in some list: each block collects exactly these entries.
3. Their scores are resolved exactly, those below the bound are dropped, and the best k of all blocks are ranked.

Queries and candidates meet in blocks of bounded size, one task each; no list leaves its block whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.session import materialize

K, LISTS, SCALE = 5, 4, 256
ROWS, QUERIES = 8192, 2048
#: Queries that are compared with a block at once.
STEP = 128

_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _read(table: pa.Table, name: str, width: int) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of the k best of each row and of all that tie with the last of them."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -k, axis=1)[:, -k, None]


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _blocks(width: int, k: int, lists: int, bounded: bool):
    runs = np.array_split(np.arange(width), min(lists, width))

    def run(queries, rows):
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            q, v = _read(queries, "asked", width), _read(rows, "vector", width)
            qid, vid = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
            qrow, vrow = queries["query_row"].to_numpy(), rows["row"].to_numpy()
            bound = queries["bound"].to_numpy(zero_copy_only=False).astype(np.float64) if bounded else None
            for at in range(0, len(q), STEP):
                some = slice(at, at + STEP)
                partial = [q[some][:, r] @ v[:, r].T for r in runs]  # whole numbers, exact in double precision
                total, self_ = sum(partial), qrow[some][:, None] == vrow[None, :]
                want = np.zeros(total.shape, bool)
                for p in partial:
                    if bounded:  # phase 2: entries at the uniform threshold
                        want |= p * len(runs) >= bound[some][:, None]
                    else:  # phase 1: the heads of the lists
                        p[self_] = -np.inf
                        want |= _best(p, k)
                want &= ~self_
                if bounded:  # phase 3: resolved exactly
                    want &= total >= bound[some][:, None]
                for n in np.flatnonzero(want.any(axis=1)):
                    own = np.flatnonzero(want[n])
                    own = own[_top(vid[own], total[n, own], k)]
                    out[0].append(np.full(len(own), qid[at + n]))
                    out[1].append(vid[own])
                    out[2].append(total[n, own].astype(np.int64))
        return pa.Table.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], schema=_OUT)

    return run


def _meet(queries: DataFrame, rows: DataFrame, width: int, k: int, lists: int, bounded: bool) -> DataFrame:
    by = ("row_block", "query_block")
    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_blocks(width, k, lists, bounded), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 50, k: int = K, lists: int = LISTS, scale: int = SCALE) -> DataFrame:
    """For each row whose vec_id is divisible by `every`: query_id, rank, vec_id, score of its `k` best other rows.

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; zero vectors do. Rows that repeat a vec_id are candidates of their own; as a query a repeated id counts once,
    with its smallest vector, and all other rows are its candidates. A query with fewer than `k` candidates gets all of them,
    and one without any none. Vectors must be of one length.
    """
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col("vec_id").isNotNull()
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")  # stored, so a row keeps its number
    size = rows.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))).alias("q"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    none = rows.where("false").selectExpr("vec_id as query_id", "1 as rank", "vec_id", "vec_id as score")
    if not size["q"] or not size["high"]:
        return none
    if size["low"] != size["high"]:
        raise ValueError(f"vectors of {size['low']} and of {size['high']} components can't be compared")
    width, n_rows, n_queries = size["high"], math.ceil(size["n"] / ROWS), math.ceil(size["q"] / QUERIES)
    own = lambda n, key="row": F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("row_block", own(n_rows)).withColumn("query_block", each(n_queries))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("vector", "row")).alias("q"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("q.vector").alias("asked"), F.col("q.row").alias("query_row"), own(n_queries, "vec_id").alias("query_block"))
    asked = materialize(asked, "topk-queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    heads = _meet(asked.withColumn("row_block", each(n_rows)), candidates, width, k, lists, False)
    kth = heads.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).groupBy("query_id")
    # With fewer than k candidates in the heads there are no more in all: everything is wanted.
    bounds = materialize(kth.agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("bound")), "topk-bounds")
    asked = asked.join(bounds, "query_id").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    found = _meet(asked.withColumn("row_block", each(n_rows)), candidates, width, k, lists, True)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings WHERE embedding IS NOT NULL),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
