"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; `bytes.split()` cuts UTF-8 at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a batch whose values are Python objects at once.
AT_ONCE = 256


def give_back() -> None:
    """Free memory goes back to the system: neither Arrow nor the C library (glibc; others have no such call) does so by itself."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def values_of(column: pa.Array):
    """The column's values in order; only `AT_ONCE` of them are Python objects at a time."""
    for at in range(0, len(column), AT_ONCE):
        yield from column.slice(at, AT_ONCE).to_pylist()


def giving_back(run):
    """`run` over batches; when its task is done, the worker, which Spark keeps, gives the memory of its batches back."""

    def held(batches):
        yield from run(batches)
        give_back()

    return held


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores in front as it takes to clash with no column of `df` (case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key's text modulo `n`; null for a null key."""
    return F.expr(f"crc32(cast(`{key}` as string)) % {n}")


def hash_sample(df: DataFrame, n: int, limit: int, *keys: str) -> DataFrame:
    """The `limit` rows of `df` (about `n` rows) with the smallest hash of `keys`.

    Rows whose hash can't be among them are dropped where they are read, so no task sends more than its share.
    """
    if n > 2 * limit:
        df = df.where(F.xxhash64(*keys) <= int(-(2**63) + 2**64 * min(1.0, (1.2 * limit + 200) / n)))
    return df.orderBy(F.xxhash64(*keys), *keys).limit(limit)


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case (`bytes.lower` changes ASCII letters only)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a text of words joined by one space."""
    if not joined:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
