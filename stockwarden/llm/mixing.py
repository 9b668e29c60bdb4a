"""Mixing sources to target word counts by Pareto order sampling, in DataFrame functions only.

Every source has a weight; together the targets are `share` times all words, no target above `most` times its source's
words, the excess going to the others by weight. Within a source a document is expected `target / source words` times:
the whole part is allocated to every document for certain, the fraction is its inclusion probability p. Documents are
ranked by Pareto order, q = (u / (1 - u)) / (p / (1 - p)) with u from a hash of the document, and the smallest q are
included until the sample has the words that are left of the target; its size is thus fixed, in words.

The cut is found without ordering a source as a whole: words are summed by steps of q / (1 + q), and only the step in
which the target is reached is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.llm.common import WORD, fresh
from stockwarden.session import materialize

SHARE, MOST = 1.5, 2.0
WEIGHTS = (3, 1, 2)
#: Steps of q / (1 + q) for each source.
STEPS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, salt: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of id and text, the same in every run."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, source_size): source, source_size, target.

    Sources take the weights in turn, by code point with null last. The level at which uncapped targets stand comes from
    running sums over the sources in order of their caps per weight; there is one row per source here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    by_cap = Window.orderBy("limit", F.col("source").asc_nulls_last())
    upto, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # `level` is where the rest would stand if exactly the sources before this one were capped. It holds if it is within this
    # source's limit; later ones then stand lower, so the highest level that holds is the one wanted.
    levelled = (
        sizes.withColumn("weight", weight).withColumn("limit", most * F.col("source_size") / F.col("weight"))
        .withColumn("below", F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(whole) - F.col("below")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("limit"), F.col("level"))).over(whole))
    )
    cap = most * F.col("source_size")
    return levelled.select("source", "source_size", F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap)).alias("target"))


def _measured(docs: DataFrame, salt: str) -> dict[str, Column]:
    return {"size": words_in(F.col("text")), "u": uniform(F.col("doc_id"), F.col("text"), salt)}


def mixed(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, salt: str = "mix") -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken.

    A null text has size 0; documents of size 0 take no words. A null source is a source of its own. Rows that repeat an
    id and a text are tied, so it does not show which of them is included. No rows give no rows.
    """
    made = [c.alias(name) for name, c in _measured(docs, salt).items()]
    slim = materialize(docs.select("doc_id", "source", *made, F.monotonically_increasing_id().alias("row")), "mixing-rows")
    out = _plan(slim, share, most, weights)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS, salt: str = "mix") -> DataFrame:
    """The mixed corpus: every row of `docs` as many times as the mix takes it, with the columns of `docs`.

    Rows are known by a hash of id, text and source, so no copy of the texts is stored. Rows that repeat all three are one
    document, which the mix takes as often as all of them together.
    """
    key, n, copies = fresh(docs, "key"), fresh(docs, "n"), fresh(docs, "copies")
    keyed = F.xxhash64("doc_id", "text", "source")
    made = [c.alias(name) for name, c in _measured(docs, salt).items()]
    slim = materialize(docs.select("doc_id", "source", *made, keyed.alias("key"), F.monotonically_increasing_id().alias("row")), "mixing-sizes")
    taken = _plan(slim, share, most, weights).groupBy(F.col("key").alias(key)).agg(F.sum("copies").cast("int").alias(copies))
    taken = materialize(taken.where(F.col(copies) > 0), "mixing-copies")
    rows = docs.withColumn(key, keyed).dropDuplicates([key, "doc_id"]) if _repeats(slim) else docs.withColumn(key, keyed)
    return rows.join(taken, key).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def _repeats(slim: DataFrame) -> bool:
    """Whether any row is repeated; without repeats there is nothing to reduce before the join."""
    return not slim.groupBy("key").count().where("count > 1").isEmpty()


def _plan(slim: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """`slim` (row, doc_id, source, size, u) with source_size, target and copies."""
    whole = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialize(targets(whole, share, most, weights), "mixing-targets")
    # The bound of this broadcast is one row per source, checked by the planner against its threshold (no hint).
    met = slim.alias("d").join(aims.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    met = met.select("d.*", "source_size", "target", each.alias("each"))
    met = met.withColumn("certain", F.floor("each")).withColumn("p", F.col("each") - F.col("certain"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    met = met.withColumn("q", F.when(F.col("p") > 0, odds))
    met = met.withColumn("step", F.least(F.floor(F.col("q") / (1 + F.col("q")) * STEPS), F.lit(STEPS - 1)))
    sums = met.where("q is not null").groupBy("source", "step").agg(F.sum("size").alias("words"), F.max(F.col("p") * F.col("source_size")).alias("need"))
    running = Window.partitionBy("source").orderBy("step")
    before = F.coalesce(F.sum("words").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = sums.withColumn("before", before).where("before < need").groupBy("source").agg(F.max_by(F.struct("step", "before", "need"), "step").alias("cut"))
    cuts = materialize(cuts.select(F.col("source").alias("of"), "cut.*"), "mixing-cuts").withColumnRenamed("step", "last")
    met = met.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    inside = met.where("step = last")
    ranked = Window.partitionBy("source").orderBy("q", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    # A document belongs to the sample if its middle word does: the sample ends within half a document of what is needed.
    middle = F.col("before") + F.coalesce(F.sum("size").over(ranked), F.lit(0)) + F.col("size") / 2
    inside = inside.withColumn("more", (middle <= F.col("need")).cast("long"))
    rest = met.where("step is null or last is null or step <> last").withColumn("more", F.coalesce(F.col("step") < F.col("last"), F.lit(False)).cast("long"))
    return inside.unionByName(rest).select(*slim.columns, "source_size", "target", (F.col("certain") + F.col("more")).cast("long").alias("copies"))


ORACLE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || COALESCE(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
whole AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
turned AS (SELECT *, CAST(CASE (ROW_NUMBER() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM whole),
capped AS (
  SELECT *, 2.0 * source_size / weight AS lim,
         COALESCE(SUM(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         SUM(weight) OVER (ORDER BY 2.0 * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened
  FROM turned),
levels AS (SELECT *, (1.5 * (SELECT SUM(source_size) FROM whole) - below) / opened AS lvl FROM capped),
aims AS (
  SELECT source, source_size, LEAST(2.0 * source_size, COALESCE((SELECT MAX(lvl) FROM levels WHERE lvl <= lim) * weight, 2.0 * source_size)) AS target FROM levels),
met AS (
  SELECT d.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS each_one
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source),
drawn AS (SELECT *, FLOOR(each_one) AS certain, each_one - FLOOR(each_one) AS p FROM met),
ranked AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn),
summed AS (
  SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY q, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)
SELECT doc_id, size, source_size, ROUND(target, 3) AS target,
       CAST(size * (certain + CASE WHEN p > 0 AND before + size / 2.0 <= p * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""
