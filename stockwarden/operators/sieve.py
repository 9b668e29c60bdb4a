"""A small bitmap of hashed ids: a coarse test in the scan stage before lines are shuffled to the few ids that are wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.session import materialize

#: Words of 64 bits the bitmap has at most: 8 MB, whatever the number of ids. More ids only let more other lines through.
WORDS = 1 << 19


def _place(key: str) -> tuple[Column, Column]:
    """The word of an id and its bit in it."""
    hashed = F.xxhash64(key)
    return F.shiftrightunsigned(hashed, 6).bitwiseAND(WORDS - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), hashed.bitwiseAND(63).cast("int"))


def bitmap(ids: DataFrame, key: str) -> DataFrame:
    """(word, mask) with a bit for every id in `key`, nulls left out."""
    word, bit = _place(key)
    marked = ids.filter(F.col(key).isNotNull()).select(word.alias("word"), bit.alias("mask"))
    return materialize(marked.groupBy("word").agg(F.bit_or("mask").alias("mask")), "bitmap")


def may_match(lines: DataFrame, marks: DataFrame, key: str, column: str) -> DataFrame:
    """`lines` with `column`: false where `key` is surely none of the ids. The bitmap is a table of at most `WORDS` rows."""
    word, bit = _place(key)
    placed = lines.withColumn("_word", word).join(F.broadcast(marks.withColumnsRenamed({"word": "_word", "mask": "_mask"})), "_word", "left")
    hit = F.col("_mask").bitwiseAND(bit) != 0
    return placed.withColumn(column, F.col(key).isNotNull() & F.coalesce(hit, F.lit(False))).drop("_word", "_mask")
