"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one pass over the bytes of a text. Trees are grown level by level on binned statistics, each split
from gradient histograms, and flattened into arrays (feature, cut, leaf value by position), so scoring a batch is a few
numpy lookups per level. The trees are fitted on at most `sample_rows` labelled rows (a documented bound; rows are chosen
by a hash of their id); every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from stockwarden.llm.common import crc_mod, giving_back, values_of

SAMPLE_ROWS = 40_000
THRESHOLD = 0.3

_CLASS = np.full(256, 6, np.int64)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 common punctuation, 6 symbol, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 5
_EACH = np.frombuffer(b"!#$%&*|<>{}=/@_~^+\\", np.uint8)
STATISTICS = (
    "bytes", "words", "lower", "upper", "digits", "spaces", "punctuation", "symbols", "beyond_ascii", "word_length", "longest_word",
    "distinct_words", "lines", "line_length", "repeated_lines", "sentence_lines", "capital_words", "symbol_words", "commonest_word",
    *(f"byte_{c}" for c in _EACH),
)
_SYMBOL_END = re.compile(rb"[#$%&*!|<>{}=@_~^+]")


def statistics_of(text: str | None) -> np.ndarray:
    """The statistics of one text; all zero for a null or blank one."""
    out = np.zeros(len(STATISTICS))
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=8) / len(raw)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[:19] = (
        np.log1p(len(raw)), np.log1p(len(words)), *kinds[:4], *kinds[5:8], lengths.mean(), np.log1p(lengths.max()),
        len(distinct) / len(words), np.log1p(len(lines)), np.log1p(len(raw) / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in b".!?\"'" for x in lines) / len(lines),
        sum(n for w, n in distinct.items() if 65 <= w[0] <= 90) / len(words),
        sum(n for w, n in distinct.items() if _SYMBOL_END.match(w[-1:])) / len(words),
        max(distinct.values()) / len(words),
    )
    out[19:] = counts[_EACH] / len(words)
    return out


def statistics(texts) -> np.ndarray:
    rows = [statistics_of(t) for t in texts]
    return np.stack(rows) if rows else np.zeros((0, len(STATISTICS)))


@dataclass
class Trees:
    """Complete trees of `depth` levels. Node k of a level has the children 2k and 2k+1; cuts are on raw statistics."""

    base: float
    features: np.ndarray  # trees x (2**depth - 1)
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2**depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        depth, rows = self.leaves.shape[1].bit_length() - 1, np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                at = node + (1 << level) - 1
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            total += leaf[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees=60, depth=3, bins=64, rate=0.15, ridge=2.0, least=8) -> Trees:
    """Boosted trees for 0/1 labels. One class or no row gives no trees: every score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes = (1 << depth) - 1
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    raw, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        for level in range(depth):
            width = 1 << level
            best = np.zeros(width)
            at, pick = np.zeros(width, np.int64), np.full(width, -1)
            for f in range(len(binned)):
                if not len(edges[f]):
                    continue
                key = node * bins + binned[f]
                hist = [np.bincount(key, weights=w, minlength=width * bins).reshape(width, bins) for w in (g, h, None)]
                left = [np.cumsum(a, axis=1)[:, : len(edges[f])] for a in hist]
                whole = [a.sum(axis=1, keepdims=True) for a in hist]
                right = [b - a for a, b in zip(left, whole, strict=True)]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge)
                gain[(left[2] < least) | (right[2] < least)] = 0
                top = gain.argmax(axis=1)
                won = gain[np.arange(width), top] > best + 1e-9
                best[won], at[won], pick[won] = gain[np.arange(width), top][won], top[won], f
            go = np.zeros(len(y), bool)
            for k in np.flatnonzero(pick >= 0):
                i = width - 1 + k
                feature[i], cut[i] = pick[k], edges[pick[k]][at[k]]
                here = node == k
                go[here] = binned[pick[k]][here] > at[k]
            node = 2 * node + go
        leaf = rate * np.bincount(node, weights=g, minlength=nodes + 1) / (np.bincount(node, weights=h, minlength=nodes + 1) + ridge)
        raw = raw + leaf[node]
        for store, one in zip(out, (feature, cut, leaf), strict=True):
            store.append(one)
    return Trees(base, *(np.stack(s) for s in out))


@arrow_udf(ArrayType(DoubleType()))
def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from giving_back(lambda given: (pa.array(list(statistics(values_of(texts))), pa.list_(pa.float64())) for texts in given))(batches)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 5) -> Trees:
    """Trees for label 1 of `labels.quality`, from labelled documents whose crc32(doc_id) modulo `folds` is not 0.

    Rows with a null id or label take no part; a repeated id counts once with its smallest label and once per text.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(crc_mod("doc_id", folds) != 0)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # At most `sample_rows` ids and labels: a proven bound for the broadcast, and for what the driver receives.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = met.select("doc_id", (F.col("quality") == 1).cast("int").alias("y"), _statistics("text").alias("x"))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(STATISTICS))
    return fit_trees(x, got["y"].to_numpy(float))


def scorer(trees: Trees):
    """A column function: text -> score."""

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from giving_back(lambda given: (pa.array(trees.score(statistics(values_of(texts)))) for texts in given))(batches)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Null and blank texts have all statistics zero and get that score; a null doc_id is not held out. Repeated rows repeat.
    """
    score = scorer(fit(docs, labels, sample_rows, folds))
    held = F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False))
    out = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """`docs` without the rows that the classifier rejects; all columns stay. Learns from `training` (default: `docs`)."""
    score = scorer(fit(docs if training is None else training, labels, **settings))
    return docs.where(score(F.col("text")) >= threshold)
