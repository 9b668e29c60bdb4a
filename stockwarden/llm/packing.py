"""Packing documents into as few sequences as possible by linear grouping, then best fit.

A piece's length is between 1 and the capacity, so all lengths of a corpus of any size fit a histogram of `capacity`
numbers, and the whole plan is made on that histogram:

1. full pieces stand alone;
2. large lengths are sorted and cut into `GROUPS` groups of equal cardinality, and every length is rounded up to the
   longest of its group; with so few sizes, configurations (how many pieces of each size share a sequence) are chosen by a
   bounded knapsack over the sizes that are left, each repeated as often as the counts allow;
3. the actual lengths replace the rounded ones, longest first, which leaves more room than planned;
4. small lengths go, longest first, to the sequence with the least room that takes them, or to a new one.

The plan is a list of runs: pieces of one length with ranks from .. to go to consecutive sequences. Its size depends on
the capacity alone, so it is broadcast. Pieces get ranks within their length from counts by hash bucket, and look up
their place. Neither the documents nor a list of them ever leaves the executors.
"""

from __future__ import annotations

import contextlib
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stockwarden.llm.common import giving_back
from stockwarden.session import materialize

CAPACITY, END = 4096, 1
GROUPS = 256
#: Lengths above this share of the capacity are large: at most two share a sequence, so configurations stay few.
LARGE = 1 / 3
#: Pieces that one task numbers.
NUMBERED = 250_000
#: Words whose ids a worker remembers in each of two generations; the ids of a word never depend on its neighbours.
REMEMBERED = 400_000

#: White space that the vocabulary's normaliser knows; `str.split` knows four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_MORE = re.compile("[\x1c-\x1f]")


#: Marks that end words; before them a word of letters is a token sequence of its own, and so is a run of them.
_MARKS = ".,;:!?\"%&*$#|-"
#: Longer words are forgotten after their batch.
LONG = 64


class WordIds:
    """Ids of whole texts, looked up word by word: white space always ends a word of this vocabulary and has no id.

    The new words of a batch are encoded together. Words of letters, and the marks behind them, are each one unit of the
    vocabulary's splitter, whose last token carries the end-of-word sign: that is where the ids of one word end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, n in self.tokenizer.get_vocab().items():
            self.ends[n] = token.endswith("</w>")

    @staticmethod
    def _words(text: str | None) -> list[str]:
        if not text:
            return []
        if "<|" not in text:  # the normaliser lowers these anyway; special tokens are matched before it
            if text.isascii():
                text = text.lower()
            else:
                with contextlib.suppress(UnicodeEncodeError):
                    text.encode("latin-1")
                    text = text.lower()
        return [w for w in _SPACE.split(text) if w] if _MORE.search(text) else text.split()

    def of_all(self, texts) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit numbers."""
        split = [self._words(t) for t in texts]
        if len(self.known) > REMEMBERED:  # what was used since the last change of generations stays at hand
            self.older, self.known = self.known, {}
        known = self.known
        self._learn([w for w in set().union(*split) if w not in known])
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in [w for w in self.long if w in known]:
            del known[w]
        return out

    def of(self, text: str | None) -> bytes:
        return self.of_all([text])[0]

    def _learn(self, words: list[str]) -> None:
        known, parts, whole = self.known, {}, []
        self.long = [w for w in words if len(w) > LONG]
        for w in words:
            if w in self.older:
                known[w] = self.older[w]
            elif w.isalpha():
                whole.append(w)
            else:
                stem = w.rstrip(_MARKS)
                if stem.isalpha() or not stem:
                    parts[w] = (stem, w[len(stem) :])
                else:
                    known[w] = self._ids(w)
        units = {u for pair in parts.values() for u in pair if u and u not in known} | set(whole)
        found = dict(self._units(sorted(units)))
        known.update((w, found[w]) for w in whole)
        for w, (stem, tail) in parts.items():
            known[w] = b"".join(found.get(u) or known[u] for u in (stem, tail) if u)

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _units(self, units: list[str]):
        for at in range(0, len(units), 4096):
            some = units[at : at + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw = ids.tobytes()
                ends = (4 * cuts).tolist()
                yield from zip(some, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True)
            else:  # a letter that the normaliser turns into more than letters
                yield from ((u, self._ids(u)) for u in some)


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


#: Bytes of the texts whose words are held as Python objects at once.
TOGETHER = 1 << 21


def _slices(batch: pa.RecordBatch):
    """The batch in runs of rows of about TOGETHER bytes of text, one row at least."""
    sizes = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column("text")).to_pylist()])
    ends = np.flatnonzero(np.diff(sizes // TOGETHER)) + 1
    for at, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
        yield batch.slice(at, end - at)


_PIECES = [("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """The pieces of every document: row, doc_id, piece, start, length, ids_crc32 and, if kept, ids."""
    schema = pa.schema([*_PIECES, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def cut(batches):
        known = word_ids(vocabulary)
        for batch in (part for whole in batches for part in _slices(whole)):
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("row", "doc_id")]
            for row, doc, ids in zip(*columns, known.of_all(batch.column("text").to_pylist()), strict=True):
                ids += END.to_bytes(4, "little")
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((row, doc, n, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if keep_ids else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    kinds = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(giving_back(cut), kinds)


class _Plan:
    """Runs of sequences with equal contents, by the room left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.room = [[] for _ in range(capacity + 1)]  # room -> [(first sequence, how many)]
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, from rank, pieces, first sequence, pieces in each, offset

    def new(self, n: int) -> tuple[int, int]:
        self.sequences += n
        return self.sequences - n, n

    def put(self, length: int, rank: int, n: int, first: int, each: int, room: int) -> None:
        self.runs.append((length, rank, n * each, first, each, self.capacity - room))


def _configuration(sizes: np.ndarray, left: np.ndarray, lead: int, capacity: int) -> np.ndarray:
    """Counts by size that fill a sequence best, one piece of size `lead` included: bounded knapsack over what is left."""
    room = capacity - int(sizes[lead])
    used = np.full((len(sizes) + 1, room + 1), -1, np.int64)  # pieces of size k in the first filling found of each total
    total = np.zeros(room + 1, bool)
    total[0] = True
    spare = left.copy()
    spare[lead] -= 1
    for k in range(lead, len(sizes)):
        size, most = int(sizes[k]), int(min(spare[k], room // sizes[k]))
        reached, count = total.copy(), np.where(total, 0, -1)
        for n in range(1, most + 1):
            more = np.zeros(room + 1, bool)
            more[n * size :] = total[: room + 1 - n * size]
            count[more & ~reached] = n
            reached |= more
        used[k], total = count, reached
    at, out = int(np.flatnonzero(total).max()), np.zeros(len(sizes), np.int64)
    out[lead] = 1
    for k in range(len(sizes) - 1, lead - 1, -1):
        out[k] += used[k, at]
        at -= int(used[k, at]) * int(sizes[k])
    return out


def plan(counts: np.ndarray, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """Runs (length, from rank, pieces, first sequence, pieces in each, offset) that place `counts[length]` pieces each."""
    capacity = len(counts) - 1
    out = _Plan(capacity)
    if counts[capacity]:
        first, n = out.new(int(counts[capacity]))
        out.put(capacity, 0, n, first, 1, capacity)
    limit = max(1, int(capacity * large))
    lengths = [x for x in range(capacity - 1, limit, -1) if counts[x]]
    total = int(sum(counts[x] for x in lengths))
    queues, sizes = [], []  # by group: runs of actual lengths, longest first
    if total:
        each, filled = -(-total // groups), 0
        for x in lengths:
            rank, n = 0, int(counts[x])
            while n:
                if filled % each == 0:
                    queues.append([])
                    sizes.append(x)
                take = min(n, each - filled % each)
                queues[-1].append([x, rank, take])
                rank, n, filled = rank + take, n - take, filled + take
    sizes, left = np.array(sizes, np.int64), np.array([sum(r[2] for r in q) for q in queues], np.int64)
    while left.sum():
        lead = int(np.flatnonzero(left)[0])
        chosen = _configuration(sizes, left, lead, capacity)
        times = int((left[chosen > 0] // chosen[chosen > 0]).min())
        left -= chosen * times
        runs = [(*out.new(times), capacity)]  # first sequence, how many, room
        for k in np.flatnonzero(chosen):
            for _ in range(chosen[k]):
                after = []
                for first, n, room in runs:
                    while n:
                        run = queues[k][0]
                        take = min(n, run[2])
                        out.put(run[0], run[1], take, first, 1, room)
                        after.append((first, take, room - run[0]))
                        first, n, run[1], run[2] = first + take, n - take, run[1] + take, run[2] - take
                        if not run[2]:
                            queues[k].pop(0)
                runs = after
        for first, n, room in runs:
            out.room[room].append((first, n))
    for x in range(limit, 0, -1):
        rank, n, room = 0, int(counts[x]), x
        while n:
            while room <= capacity and not out.room[room]:
                room += 1
            if room > capacity:
                first, many = out.new(-(-n // (capacity // x)))
                room = capacity
            else:
                first, many = out.room[room].pop()
            each = room // x
            full = min(many, n // each)  # sequences that take `each` pieces
            if full:
                out.put(x, rank, full, first, each, room)
                out.room[room - each * x].append((first, full))
                rank, n = rank + full * each, n - full * each
            if full < many:
                if 0 < n < each:
                    out.put(x, rank, 1, first + full, n, room)
                    out.room[room - n * x].append((first + full, 1))
                    full, n = full + 1, 0
                if full < many:
                    out.room[room].append((first + full, many - full))
            room = x if room == capacity else room
    return np.array(sorted(out.runs), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = True, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null or empty text is the end id alone. Rows that repeat an id are packed each. No documents give no rows. Only
    doc_id and text are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, capacity, keep_ids), "packing-pieces")
    lengths = cut.groupBy("length").count().collect()  # one row per length: at most `capacity`
    counts = np.zeros(capacity + 1, np.int64)
    for row in lengths:
        counts[row["length"]] = row["count"]
    runs = spark.sparkContext.broadcast(plan(counts, groups))
    buckets = max(1, -(-int(counts.sum()) // NUMBERED))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    own = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    numbered = cut.withColumn("own", F.row_number().over(own) - 1).join(offsets.select("length", "bucket", "before"), ["length", "bucket"])

    @pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, base = runs.value, 1 << 44
        k = np.searchsorted(at[:, 0] * base + at[:, 1], length.to_numpy() * base + rank.to_numpy(), side="right") - 1
        n = rank.to_numpy() - at[k, 1]
        return pd.DataFrame({"sequence_id": at[k, 3] + n // at[k, 4], "offset": at[k, 5] + n % at[k, 4] * length.to_numpy()})

    placed = numbered.withColumn("at", place("length", F.col("own") + F.col("before")))
    ids = ["ids"] if keep_ids else []
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *ids)
