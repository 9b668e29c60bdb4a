"""Toxicity: a logistic classifier that is penalised for changing its mind when a group is named in place of another.

Features are words and the beginnings of words (4 to 8 bytes), each with the logarithm of its count; the features that part
the labels best are kept. In every sentence of a labelled document that names a group of people the name is swapped for the
other names of its set, and the squared change of the logit, averaged over all swaps, is part of what the fit minimises. A
name that stands in toxic sentences more often than its peers so gets no weight of its own, and neutral mentions stay clean.

Labelled documents are a bounded sample (`SAMPLE_ROWS`, by a hash of the id); their counts are summed in Spark, and the fit
sees only kept features. Every document is scored over its whole text, in pieces of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stockwarden.llm.common import crc_mod, hash_sample
from stockwarden.session import materialize

SAMPLE_ROWS, FEATURES, FOLDS, HELD, THRESHOLD = 16_000, 4096, 4, 2, 0.3
#: Weight of the counterfactual penalty, of the squared weights, and the fewest documents of a kept feature.
STRENGTH, RIDGE, LEAST = 1.0, 0.001, 3
BEGINNINGS = (4, 5, 6, 7, 8)
PIECE = 1 << 20

# Names of groups of people that may stand for one another.
IDENTITIES = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "african", "european", "arab", "latino", "indigenous"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"), ("elderly", "teenage"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("musulman", "chrétien", "juif"), ("noirs", "blancs"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("muslimisch", "christlich", "jüdisch"), ("ausländer", "inländer"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "nativos"),
)

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[48:58] = _IN_WORD[128:] = True
_GAP = re.compile(rb"[^a-z0-9\x80-\xff]")
_SENTENCE = re.compile(r"[^.!?\n]+")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _bytes(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace") if text else b""


def _stirred(x: np.ndarray, kind: int) -> np.ndarray:
    x = x + np.uint64((kind * 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(1)


def _hashed(rows: list[int], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every feature of some texts, repeats included.

    A word's hash is a difference of running sums, moved to a common place by an inverse power: no loop over words.
    """
    b = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(b)), dtype=np.uint64)))
        back = _powers(_BACK, len(b))
        inside = _IN_WORD[b]
        before = np.concatenate(([False], inside[:-1]))
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
        row = np.array(rows, np.int64)[np.searchsorted(ends, start, side="right")]
        out, of = [_stirred((sums[end] - sums[start]) * back[start], 0)], [row]
        for k in BEGINNINGS:
            long = end - start >= k
            out.append(_stirred((sums[start[long] + k] - sums[start[long]]) * back[start[long]], k))
            of.append(row[long])
    return np.concatenate(of), np.concatenate(out).astype(np.int64)


def features(texts):
    """(row, feature) arrays of the texts, one pair for each piece of about `PIECE` bytes; texts are cut between words only."""
    rows, pieces, size = [], [], 0
    for n, text in enumerate(texts):
        raw, at = _bytes(text), 0
        while at < len(raw):
            gap = _GAP.search(raw, at + PIECE)
            to = gap.start() if gap else len(raw)
            rows.append(n)
            pieces.append(raw[at:to])
            size, at = size + to - at, to
            if size >= PIECE:
                yield _hashed(rows, pieces)
                rows, pieces, size = [], [], 0
    if pieces:
        yield _hashed(rows, pieces)


def kept_counts(texts, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in `kept`, count) of the kept features of the texts; `kept` is sorted."""
    found = [np.empty(0, np.int64)]
    for row, feature in features(texts):
        if len(kept):
            place = np.minimum(np.searchsorted(kept, feature), len(kept) - 1)
            hit = kept[place] == feature
            found.append(row[hit] * len(kept) + place[hit])
    key, count = np.unique(np.concatenate(found), return_counts=True)
    return (key // len(kept), key % len(kept), count) if len(kept) else (key, key, count)


@dataclass
class Model:
    kept: np.ndarray  # features, ascending
    weights: np.ndarray
    base: float

    def score(self, texts) -> np.ndarray:
        texts = list(texts)
        row, place, count = kept_counts(texts, self.kept)
        logit = self.base + np.bincount(row, weights=self.weights[place] * np.log1p(count), minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _distinct(row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (feature[1:] != feature[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], feature[new]


def _count(batches):
    """(text, y) -> feature, y, documents of a batch that have it."""
    for batch in batches:
        y = batch.column("y").to_numpy()
        seen = [_distinct(*pair) for pair in features(batch.column("text").to_pylist())]
        if seen:
            row, feature = _distinct(*(np.concatenate(p) for p in zip(*seen, strict=True)))  # a text may stand in two pieces
            for label in (0, 1):
                own, n = np.unique(feature[y[row] == label], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), label), pa.int32()), pa.array(n, pa.int64())], names=["feature", "y", "n"])


def _runs(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def _vectors(kept: np.ndarray):
    def run(batches):
        for batch in batches:
            row, place, count = kept_counts(batch.column("text").to_pylist(), kept)
            starts = pa.array(_runs(row, batch.num_rows), pa.int32())
            at, of = pa.ListArray.from_arrays(starts, pa.array(place, pa.int32())), pa.ListArray.from_arrays(starts, pa.array(np.log1p(count), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("y"), at, of], names=["y", "at", "of"])

    return run


def swaps(texts, identities) -> Counter:
    """(sentence, the same with a name swapped) for every name of a group in every sentence, with how often each occurs.

    Of a sentence only its names are returned, in order: all else is the same on both sides.
    """
    peers = {name: own for own in identities for name in own}
    named = re.compile(r"\b(" + "|".join(map(re.escape, sorted(peers, key=len, reverse=True))) + r")\b")
    out: Counter = Counter()
    for text in texts:
        for sentence in _SENTENCE.findall(text.lower()) if text else ():
            names = named.findall(sentence)
            for name in set(names):
                for peer in peers[name]:
                    if peer != name:
                        out[" ".join(sorted(names)), " ".join(sorted(peer if n == name else n for n in names))] += 1
    return out


def _swaps(identities):
    def run(batches):
        for batch in batches:
            found = swaps(batch.column("text").to_pylist(), identities)
            if found:
                before, after = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(after), pa.array(list(found.values()), pa.int64())], names=["before", "after", "n"])

    return run


class _Rows:
    """A sparse matrix by rows."""

    def __init__(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.place, self.value, self.shape = row, place, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.place], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=self.value * r[self.row], minlength=self.shape[1])


def minimise(x: _Rows, y: np.ndarray, changes: _Rows, often: np.ndarray, strength: float, ridge: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Weights and base of least mean log loss + ridge / 2 |w|^2 + strength / 2 the mean squared change over all swaps.

    Accelerated gradient steps; the step length comes from the largest curvature, by power iteration. A base that is constant
    is learned with a column of ones.
    """
    n, width = x.shape
    share = often / max(1.0, often.sum())

    def curved(v, b):
        return x.back(x.dot(v) + b) / (4 * n) + ridge * v + strength * changes.back(share * changes.dot(v)), (x.dot(v) + b).sum() / (4 * n)

    v, b = np.ones(width), 1.0
    for _ in range(25):
        size = max(np.sqrt(v @ v + b * b), 1e-12)
        v, b = curved(v / size, b / size)
    step = 0.9 / max(np.sqrt(v @ v + b * b), 1e-9)
    prior = (y.sum() + 1) / (n + 2)
    w, base = np.zeros(width), float(np.log(prior / (1 - prior)))
    u, bu, t = w, base, 1.0
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(x.dot(u) + bu, -30, 30))) - y
        slope = x.back(off) / n + ridge * u + strength * changes.back(share * changes.dot(u))
        w_next, base_next, t_next = u - step * slope, bu - step * off.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, bu = w_next + (t - 1) / t_next * (w_next - w), base_next + (t - 1) / t_next * (base_next - base)
        w, base, t = w_next, base_next, t_next
    return w, float(base)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, strength: float = STRENGTH, identities=IDENTITIES,
        folds: int = FOLDS, held: int = HELD) -> Model:
    """A model of label 1 of `labels.toxic`, from labelled documents whose crc32(doc_id) modulo `folds` is not `held`.

    Rows with a null id or label take no part; a repeated id counts once, with its smallest label and text. Without labels of
    both kinds there are no weights: every score is the smoothed share of label 1.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", folds) != held).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    chosen = hash_sample(known, known.count(), sample_rows, "doc_id")
    # At most `sample_rows` ids and labels: a proven bound for the broadcast.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = materialize(met.groupBy("doc_id").agg(F.min("text").alias("text"), (F.min("toxic") == 1).cast("int").alias("y")), "toxicity-sample").select("text", "y")
    n, toxic = (int(v or 0) for v in sample.agg(F.count("*"), F.sum("y")).first())
    base = float(np.log((toxic + 1) / (n - toxic + 1)))
    if toxic in (0, n):
        return Model(np.empty(0, np.int64), np.empty(0), base)
    counts = sample.mapInArrow(_count, "feature long, y int, n long").groupBy("feature").agg(
        F.sum(F.col("n") * F.col("y")).alias("t"), F.sum(F.col("n") * (1 - F.col("y"))).alias("c"))
    part = F.abs(F.col("t") / toxic - F.col("c") / (n - toxic)) / F.sqrt((F.col("t") + F.col("c") + 1) / n)
    best = counts.where(F.col("t") + F.col("c") >= min(LEAST, n)).orderBy(part.desc(), "feature").limit(n_features)
    kept = np.sort(np.array([r[0] for r in best.select("feature").collect()], np.int64))
    rows = sample.mapInArrow(_vectors(kept), "y int, at array<int>, of array<float>").toPandas()  # sample_rows rows of kept features
    sizes = rows["at"].map(len).to_numpy()
    joined = lambda name, kind: np.concatenate([np.empty(0, kind), *rows[name]]).astype(kind)
    x = _Rows(np.repeat(np.arange(len(rows)), sizes), joined("at", np.int64), joined("of", float), (len(rows), len(kept)))
    # Pairs of names: as many as the fixed sets allow.
    swapped = sample.mapInArrow(_swaps(identities), "before string, after string, n long").groupBy("before", "after").agg(F.sum("n").alias("n")).toPandas()
    sides = [kept_counts(swapped[side], kept) for side in ("before", "after")]
    changes = _Rows(*(np.concatenate(p) for p in zip(*((r, p, s * np.log1p(c)) for s, (r, p, c) in zip((-1, 1), sides, strict=True)), strict=True)), (len(swapped), len(kept)))
    return Model(kept, *minimise(x, rows["y"].to_numpy(float), changes, swapped["n"].to_numpy(float), strength, RIDGE))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without features; a null doc_id is not held out. Repeated rows repeat, and
    columns beyond doc_id and text (of `labels`: doc_id and toxic) are not read.
    """
    folds, held = settings.get("folds", FOLDS), settings.get("held", HELD)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **settings))  # at most n_features weights

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(texts))

    out = docs.select("doc_id", F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
