"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every character that is not a letter counts as a space. The counts of all n-grams of `GRAMS`
characters by hash bucket are gathered over all training documents, in chunks of buckets that are summed apart from one
another. The matrix of log probabilities (buckets x languages) is broadcast; its size is `BUCKETS` times the number of
languages, which is checked. A text is scored by summing the rows of the buckets it has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stockwarden.llm.common import crc_mod
from stockwarden.session import materialize

GRAMS, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 16, 0.5
CHUNK = 1 << 12
#: More languages than this would make the broadcast matrix large (64 MB).
MOST_LANGUAGES = 256

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Letters among the first 0x3000 characters; beyond, everything but the blocks of punctuation and symbols is a letter.
_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def characters(text: str) -> np.ndarray:
    """Code points in lower case with 32 for everything that is not a letter; runs of 32 are kept as one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = points >= 0x3400
    low = points < 0x3000
    letter[low] = _LETTER[points[low]]
    rest = ~low & ~letter
    if rest.any():
        letter[rest] = [chr(c).isalpha() for c in points[rest]]
    points = np.where(letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return points[keep]


def buckets_of(text: str) -> np.ndarray:
    """The hash buckets of all n-grams of a text, with a space before and after it."""
    own = characters(text)
    points = np.concatenate((np.array([32], np.uint32), own, np.array([32], np.uint32))) if len(own) else own
    out = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(points) >= n:
                code = np.full(len(points) - n + 1, np.uint32(n * 0x27D4EB2F % 2**32))
                for k in range(n):
                    code = (code ^ points[k : len(points) - n + 1 + k]) * _FACTORS[k % len(_FACTORS)]
                    code ^= code >> np.uint32(15)
                out.append(code % np.uint32(BUCKETS))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


_COUNTED = pa.schema([("lang", pa.string()), ("chunk", pa.int32()), ("docs", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _count(batches):
    """Bucket counts of a task's documents by language, as chunks."""
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if lang not in counts:
                if len(counts) >= MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                counts[lang], docs[lang] = np.zeros(BUCKETS, np.int64), 0
            docs[lang] += 1
            if text:
                np.add.at(counts[lang], buckets_of(text), 1)
    for lang, all_counts in counts.items():
        parts = all_counts.reshape(-1, CHUNK)
        n = len(parts)
        columns = [pa.array([lang] * n), pa.array(range(n), pa.int32()), pa.array([docs[lang]] * n), pa.array(list(parts), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)


def _add(group):
    counts = group["counts"].combine_chunks().flatten().to_numpy().reshape(-1, CHUNK).sum(axis=0)
    columns = [group["lang"].slice(0, 1).combine_chunks(), group["chunk"].slice(0, 1).combine_chunks(), pa.array([group["docs"].to_numpy().sum()]), pa.array([counts], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(columns, schema=_COUNTED)


def fit(training: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages in code point order, log probabilities buckets x languages, log priors) from (lang, text) with lang not null."""
    kinds = "lang string, chunk int, docs long, counts array<long>"
    parts = materialize(training.select("lang", "text").mapInArrow(_count, kinds), "language-counts")
    n = parts.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    summed = parts.groupBy("lang", "chunk").applyInArrow(_add, kinds).toPandas()  # languages x buckets numbers at most
    langs = sorted(summed["lang"].unique())
    counts, docs = np.zeros((len(langs), BUCKETS)), np.zeros(len(langs))
    for lang, chunk, of, values in summed.itertuples(index=False):
        k = langs.index(lang)
        counts[k, chunk * CHUNK : (chunk + 1) * CHUNK], docs[k] = values, of
    counts += SMOOTHING
    matrix = np.log(counts / counts.sum(axis=1, keepdims=True)).T if langs else np.zeros((BUCKETS, 0))
    return langs, np.ascontiguousarray(matrix, np.float32), np.log(docs / max(1.0, docs.sum()))


def predict(langs: list[str], matrix: np.ndarray, prior: np.ndarray, text: str | None) -> tuple[str, float]:
    """The likeliest language and its posterior probability; `und` and 0 without a letter or a learned language."""
    if not langs or not has_letter(text):
        return "und", 0.0
    logs = matrix[buckets_of(text)].sum(axis=0, dtype=np.float64) + prior
    best = int(logs.argmax())
    return langs[best], float(1 / np.exp(np.clip(logs - logs[best], -700, 0)).sum())


def languages(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score.

    Learns from rows with a lang whose crc32(doc_id) modulo `folds` is not `held` (a null id is not held out). Texts that are
    null or have no letter are `und` with score 0; equal scores take the first language by code point. Repeated rows repeat.
    """
    held_out = F.coalesce(crc_mod("doc_id", folds) == held, F.lit(False))
    langs, matrix, prior = fit(docs.where(~held_out & F.col("lang").isNotNull()))
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix, prior))

    @pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(*model.value, t) for t in texts], columns=["lang_pred", "score"])

    return docs.select("doc_id", held_out.alias("held_out"), scored("text").alias("at")).select("doc_id", "held_out", "at.*")
