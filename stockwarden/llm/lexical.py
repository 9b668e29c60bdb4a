"""Ranked lexical search with per-term geometric blocking.

A document's score for an item is a sum of whole numbers, one for each term of the item: the term's weight times an impact
that grows with the term's frequency and falls with the document's length.

* Documents become vectors of impacts over the terms that the items have, and are dealt over tasks by a random-projection
  sketch, so that a task's documents are alike. Tasks cut their documents into segments of bounded size.
* In a segment, every term's posting list is clustered by document similarity: representatives spread over the list, every
  document with its nearest one by cosine. A cluster is a block; its summary holds, for every term that some item asks
  together with the list's own, the largest impact in the block.
* Search reads an item's lists from the greatest possible contribution down. It stops when the lists left can't lift an
  unseen document to the k-th best score so far, and skips a block when the score of its summary can't either. Summaries
  bound every document of their block, so both are exact, and what is scored is scored in full.

Items are taken in groups of bounded text, whose terms every task gets; all documents are read for each group.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.session import materialize

K = 50
#: Bytes of item text in one group: bounds the terms that are broadcast.
GROUP_BYTES = 1 << 20
#: Cells of a segment's dense matrix, documents of a segment, and about how many documents a block has.
CELLS, ROWS, BLOCK = 1 << 23, 2048, 32
#: Items with more terms than this ask their terms together with all others.
WIDE = 512
SKETCH = 16

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or re.match(rb"[0-9a-z]", bytes([b])) else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z in lower case; none for a null."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class Asked:
    """The items of one group: `ids`, their distinct terms as numbers, and which terms are asked together."""

    def __init__(self, items: list[tuple[int | None, set[bytes]]]):
        self.ids = [i for i, _ in items]
        self.terms = sorted(set().union(*(t for _, t in items)))
        self.number = {t: n for n, t in enumerate(self.terms)}
        self.lists = [np.array(sorted(self.number[t] for t in ts), np.int64) for _, ts in items]
        held = Counter(n for own in self.lists for n in own.tolist())
        rare = np.array([math.log(1 + len(items) / held[n]) for n in range(len(self.terms))], np.float32)
        #: Directions of the sketch, longer for terms that few items have.
        self.directions = np.random.default_rng(7).standard_normal((len(self.terms), SKETCH)).astype(np.float32) * rare[:, None]
        self.together: list[np.ndarray | None] = [None] * len(self.terms)
        met: dict[int, list[np.ndarray] | None] = {}
        for own in self.lists:
            for n in own.tolist():
                if len(own) > WIDE or met.get(n, ()) is None:
                    met[n] = None
                else:
                    met.setdefault(n, []).append(own)
        for n, lists in met.items():
            self.together[n] = None if lists is None else np.unique(np.concatenate(lists))


def _groups(items: DataFrame) -> list[Asked]:
    """Items in groups of about `GROUP_BYTES` of text; rows of one item_id are one item."""
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, math.ceil((size or 0) / GROUP_BYTES))
    out = []
    for part in range(parts):
        rows: dict[int | None, set[bytes]] = {}
        for item, text in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("item_id", "text").toLocalIterator():
            rows.setdefault(item, set()).update(terms_of(text))
        some = sorted(((i, t) for i, t in rows.items() if t), key=lambda x: (x[0] is None, x[0] or 0))
        if some:
            out.append(Asked(some))
    return out


def _lists(values, starts, kind):
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _postings(shared):
    """(doc_id, text) -> doc_id, n terms, numbers and frequencies of the asked terms, sketch."""

    def run(batches):
        asked = shared.value
        for batch in batches:
            n, numbers, tfs, starts = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                terms = terms_of(text)
                n.append(len(terms))
                for term, tf in Counter(terms).items():
                    at = asked.number.get(term)
                    if at is not None:
                        numbers.append(at)
                        tfs.append(tf)
                starts.append(len(numbers))
            ids, starts = np.array(numbers, np.int64), np.array(starts)
            weighed = asked.directions[ids] * np.log1p(np.array(tfs, np.float32))[:, None]
            sums = np.add.reduceat(np.concatenate((weighed, np.zeros((1, SKETCH), np.float32))), starts[:-1], axis=0) if len(n) else np.zeros((0, SKETCH))
            bits = ((sums > 0) * (1 << np.arange(SKETCH)[::-1])).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), _lists(numbers, starts, pa.int32()), _lists(tfs, starts, pa.int32()), pa.array(bits, pa.int32())],
                names=["doc_id", "n", "numbers", "tfs", "sketch"])

    return run


def blocks_of(near: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a list's documents by block, and where blocks start, from their directions (rows of length 1)."""
    n = len(near)
    if n <= size:
        return np.arange(n), np.zeros(1, np.int64)
    heads = np.linspace(0, n - 1, math.ceil(n / size)).astype(np.int64)
    nearest = (near @ near[heads].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    sorted_ = nearest[order]
    return order, np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))


def segment(asked: Asked, ids: np.ndarray, starts: np.ndarray, numbers: np.ndarray, impacts: np.ndarray, size: int = BLOCK) -> dict:
    """The index of some documents: their vectors by row, and of every term's list the blocks with their summaries."""
    terms, local = np.unique(numbers, return_inverse=True)
    rows = np.repeat(np.arange(len(ids)), np.diff(starts))
    dense = np.zeros((len(ids), len(terms)), np.int32)
    dense[rows, local] = impacts
    near = dense.astype(np.float32) @ asked.directions[terms]
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    by_term = np.lexsort((rows, local))
    listed, ends = rows[by_term], np.searchsorted(local[by_term], np.arange(len(terms) + 1))
    place = np.full(len(asked.terms), -1)
    place[terms] = np.arange(len(terms))
    out = {"block_docs": [], "block_sizes": [], "list_sizes": [], "summary_sizes": [], "summary_terms": [], "summary_max": []}
    for t in range(len(terms)):
        own = listed[ends[t] : ends[t + 1]]
        order, heads = blocks_of(near[own], size)
        own = own[order]
        with_ = asked.together[terms[t]]
        columns = np.arange(len(terms)) if with_ is None else place[with_]
        columns = columns[columns >= 0]
        top = np.maximum.reduceat(dense[np.ix_(own, columns)], heads, axis=0)
        block, column = np.nonzero((top > 0) | (columns == t))  # at least the list's own term
        out["block_docs"].append(own)
        out["block_sizes"].append(np.diff(np.append(heads, len(own))))
        out["list_sizes"].append([len(heads)])
        out["summary_sizes"].append(np.bincount(block, minlength=len(heads)))
        out["summary_terms"].append(columns[column])
        out["summary_max"].append(top[block, column])
    return {"doc_ids": ids, "terms": terms, "row_sizes": np.diff(starts), "row_terms": local, "row_impacts": impacts} | {k: np.concatenate(v) for k, v in out.items()}


def impacts_of(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The impact of a frequency in a document of `n` terms, where `docs` documents have `length` terms in all."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))


def segments(asked: Asked, batches, docs: int, length: int):
    """Segments of postings that come in sketch order; each is dropped once it has been searched."""

    def cut(ids, starts, numbers, impacts):
        if len(ids) > 1 and len(ids) * len(np.unique(numbers)) > CELLS:
            half = len(ids) // 2
            at = starts[half]
            yield from cut(ids[:half], starts[: half + 1], numbers[:at], impacts[:at])
            yield from cut(ids[half:], starts[half:] - at, numbers[at:], impacts[at:])
        else:
            yield Segment(segment(asked, ids, starts, numbers, impacts))

    def flush(held):
        whole = pa.Table.from_batches(held).combine_chunks()
        for at in range(0, whole.num_rows, ROWS):
            part = {name: whole[name].slice(at, ROWS).combine_chunks() for name in whole.column_names}
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(part["numbers"]).to_numpy())))
            numbers, tf = (part[name].flatten().to_numpy().astype(np.int64) for name in ("numbers", "tfs"))
            yield from cut(part["doc_id"].to_numpy(), starts, numbers, impacts_of(tf, np.repeat(part["n"].to_numpy(), np.diff(starts)), docs, length))

    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            held.append(batch.slice(at, ROWS))
            rows += held[-1].num_rows
            if rows >= ROWS:
                yield from flush(held)
                held, rows = [], 0
    if rows:
        yield from flush(held)


class Best:
    """The `k` best documents of an item so far: greatest score first, then smallest id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A document must score this to matter."""
        return int(self.scores[-1]) if len(self.scores) >= self.k else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            ids, scores = np.concatenate((self.ids, ids[good])), np.concatenate((self.scores, scores[good]))
            order = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[order], scores[order]


class Segment:
    """The vectors, lists, blocks and summaries of some documents, ready to be searched."""

    def __init__(self, row: dict):
        self.ids, self.terms = row["doc_ids"], row["terms"]
        self.dense = np.zeros((len(self.ids), len(self.terms)), np.int32)
        self.dense[np.repeat(np.arange(len(self.ids)), row["row_sizes"]), row["row_terms"]] = row["row_impacts"]
        self.top = self.dense.max(axis=0).astype(np.int64) if len(self.ids) else np.zeros(0, np.int64)
        edges = lambda sizes: np.concatenate(([0], np.cumsum(sizes)))
        self.lists, self.blocks, self.sums = edges(row["list_sizes"]), edges(row["block_sizes"]), edges(row["summary_sizes"])
        self.docs, self.sum_terms, self.sum_max = row["block_docs"], row["summary_terms"], row["summary_max"].astype(np.int64)
        self.scored = self.skipped = 0

    def search(self, own: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer `best` every document that may be among its best; `own` are places in `terms`."""
        most = weights * self.top[own]
        order = np.argsort(-most, kind="stable")
        own, weights, most = own[order], weights[order], most[order]
        left = np.cumsum(most[::-1])[::-1]
        asked = np.zeros(len(self.terms), np.int64)
        asked[own] = weights
        seen = np.zeros(len(self.ids), bool)
        for t, rest in zip(own.tolist(), left.tolist(), strict=True):
            if rest < best.least:
                break  # no document that has only these terms can be among the best
            first, last = self.lists[t], self.lists[t + 1]
            low, high = self.sums[first], self.sums[last]
            bounds = np.add.reduceat(self.sum_max[low:high] * asked[self.sum_terms[low:high]], self.sums[first:last] - low)
            open_ = np.flatnonzero(bounds >= best.least) + first
            self.skipped += last - first - len(open_)
            if not len(open_):
                continue
            docs = self.docs[self.blocks[first] : self.blocks[last]] if len(open_) == last - first else np.concatenate([self.docs[self.blocks[b] : self.blocks[b + 1]] for b in open_])
            docs = docs[~seen[docs]]
            seen[docs] = True
            self.scored += len(docs)
            best.add(self.ids[docs], self.dense[np.ix_(docs, own)] @ weights)


def _search(shared, weights: np.ndarray, docs: int, length: int, k: int):
    """Postings in sketch order -> the best of each item among a task's documents."""

    def run(batches):
        asked, best = shared.value, [Best(k) for _ in shared.value.ids]
        for part in segments(asked, batches, docs, length):
            place = np.full(len(asked.terms), -1)
            place[part.terms] = np.arange(len(part.terms))
            for own, found in zip(asked.lists, best, strict=True):
                here = own[(place[own] >= 0) & (weights[own] > 0)]
                if len(here):
                    part.search(place[here], weights[here], found)
        for item, found in zip(asked.ids, best, strict=True):
            if len(found.ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found.ids), pa.int64()), pa.array(found.ids), pa.array(found.scores)], names=["item_id", "doc_id", "score"])

    return run


def weights_of(held: np.ndarray, docs: int) -> np.ndarray:
    """Weights of terms that `held` of `docs` documents have."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its `k` documents of greatest score above 0, ties to the smaller doc_id.

    Null texts have no term; items without one, or whose terms no document has, give no row. Rows that repeat an item_id are
    one item with the terms of all; rows that repeat a doc_id are documents of their own. A document with a null id counts
    in all statistics and is not listed. Columns beyond doc_id, item_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for asked in _groups(items):
        shared = spark.sparkContext.broadcast(asked)
        postings = docs.mapInArrow(_postings(shared), "doc_id long, n long, numbers array<int>, tfs array<int>, sketch int")
        postings = materialize(postings.where("n > 0"), "lexical-postings")
        n_docs, length = postings.agg(F.count("*"), F.sum("n")).first()
        held = np.zeros(len(asked.terms), np.int64)
        for number, df in postings.select(F.explode("numbers").alias("t")).groupBy("t").count().collect():  # one row per asked term
            held[number] = df
        if not held.any():
            continue
        near = postings.where("doc_id is not null and size(numbers) > 0").repartitionByRange("sketch", "doc_id").sortWithinPartitions("sketch", "doc_id")
        found = near.mapInArrow(_search(shared, weights_of(held, n_docs), n_docs, length, k), "item_id long, doc_id long, score long")
        out = out.unionByName(materialize(found, "lexical-found"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM l),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT item_id, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN f USING (term) JOIN l ON l.doc_id = f.doc_id, s GROUP BY item_id, f.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
