"""Ad-hoc questions over consumption, stock and usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.functions.dates import month_key
from stockwarden.functions.text import contains_text
from stockwarden.session import materialize

# Other names a caller may use for a grouping column.
ALIASES = {
    "unit": "hospital", "medical_unit": "hospital", "hospital_id": "hospital", "employee": "technician",
    "anesthesiologist": "doctor", "item": "product", "article": "product", "location": "sublocation",
    "case": "case_no",
}

TEXT_COLUMNS = ("product", "hospital", "doctor", "technician", "case_no", "lot", "sublocation", "warehouse", "location", "supplier", "customer", "ref", "number")


def group_key(name: str) -> Column:
    resolved = ALIASES.get(name.strip().lower(), name.strip().lower())
    if resolved == "month":
        return month_key(F.col("ts")).alias("month")
    if resolved == "day":
        return F.col("ts").cast("date").cast("string").alias("day")
    return F.col(resolved)


def group_lines(lines: DataFrame, by: list[str], values: tuple[str, ...] = ("qty", "amount"), case: str = "case_no") -> DataFrame:
    """Sums, distinct cases and lines by any of the dimensions, largest first."""
    keys = [group_key(b) for b in by]
    resolved = {ALIASES.get(b.strip().lower(), b.strip().lower()) for b in by}
    sums = [F.sum(v).alias(v) for v in values]
    distinct = [F.count_distinct(case).alias("cases")] if case in lines.columns and case not in resolved else []
    return lines.groupBy(*keys).agg(*sums, *distinct, F.count("*").alias("lines")).orderBy(F.desc(values[0]))


def search_lines(lines: DataFrame, text: str) -> DataFrame:
    return lines.filter(contains_text(text, *[F.col(c) for c in TEXT_COLUMNS if c in lines.columns]))


def query_consumption(lines: DataFrame, text: str = "", group_by: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Text filter, then grouped totals or the newest lines."""
    rows = search_lines(lines, text) if text.strip() else lines
    if group_by:
        out = group_lines(rows, group_by)
    else:
        out = rows.orderBy(F.desc("ts"), "line_id")
    return out if limit is None else out.limit(limit)


def question(rows: DataFrame, text: str = "", group_by: list[str] | None = None, sums: tuple[str, ...] = ("qty",)) -> DataFrame:
    """The same question for any source (consumption, stock, pending supply, invoices): text filter, then totals or rows."""
    found = search_lines(rows, text) if text.strip() else rows
    return group_lines(found, group_by, sums) if group_by else found


def exported(rows: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write an answer whole, with its manifest, and read back what was written."""
    from stockwarden.sources.tables import write_report

    write_report({"answer": rows}, path, fmt)
    reader = rows.sparkSession.read.schema(rows.schema)
    return reader.option("header", "true").csv(f"{path}/answer") if fmt == "csv" else reader.parquet(f"{path}/answer")


def overview(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.count("*").alias("lines"), F.count_distinct("case_no").alias("cases"),
        F.count_distinct("product_id").alias("products"), F.count_distinct("hospital").alias("hospitals"),
        F.sum("qty").alias("qty"), F.sum("amount").alias("amount"),
    )


def top_by_quantity(lines: DataFrame, dimension: str, n: int = 10) -> DataFrame:
    return lines.groupBy(dimension).agg(F.sum("qty").alias("qty")).orderBy(F.desc("qty"), dimension).limit(n)


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Rows numbered from 1 in the order of a column, without a window over all of them.

    Rows are sorted by ranges; a row's number is its place in its range plus the rows of the ranges before, one number a range.
    """
    placed = materialize(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_range", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return placed.join(ranges, "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).select(*rows.columns, name)


def with_total_row(table: DataFrame, by: str, *values: str) -> DataFrame:
    """Grouped sums plus one total row, in a single pass."""
    return (
        table.groupingSets([[F.col(by)], []], F.col(by))
        .agg(*[F.sum(v).alias(v) for v in values], F.grouping(by).cast("int").alias("is_total"))
    )


def price_by_longest_prefix(usage: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Each model takes the price of the longest prefix that starts its name; unmatched models take the default.

    Every distinct model name is expanded to its own prefixes, so the match is an equi-join, and usage rows meet a
    table with one row per model.
    """
    models = usage.select(F.lower("model").alias("model_key")).distinct()
    heads = F.transform(F.sequence(F.lit(1), F.length("model_key")), lambda n: F.substring(F.col("model_key"), F.lit(1), n))
    fits = models.withColumn("head", F.explode(heads)).join(prices.withColumn("head", F.lower("prefix")), "head")
    best = fits.groupBy("model_key").agg(F.max_by(F.struct("prefix", "price_in", "price_out", "read_weight"), F.length("prefix")).alias("p"))
    return (
        usage.withColumn("model_key", F.lower("model")).join(best, "model_key", "left")
        .select(
            *usage.columns, F.col("p.prefix").alias("prefix"),
            F.coalesce("p.price_in", F.lit(default[0])).alias("price_in"),
            F.coalesce("p.price_out", F.lit(default[1])).alias("price_out"),
            F.coalesce("p.read_weight", F.lit(0.1)).alias("read_weight"),
        )
    )


def usage_by_period(costed: DataFrame, budget_in: int, budget_out: int, warn_pct: float = 80) -> DataFrame:
    """Tokens and cost per month against the budget."""
    totals = costed.groupBy(month_key(F.col("ts")).alias("period")).agg(
        F.sum("tokens_equivalent").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.count("*").alias("calls"), F.sum("cost").alias("cost"),
    )
    pct_in = 100.0 * F.col("tokens_in") / max(1, budget_in)
    pct_out = 100.0 * F.col("tokens_out") / max(1, budget_out)
    return totals.select(
        "*", pct_in.alias("pct_in"), pct_out.alias("pct_out"),
        ((F.col("tokens_in") >= budget_in) | (F.col("tokens_out") >= budget_out)).alias("exhausted"),
        (F.greatest(pct_in, pct_out) >= warn_pct).alias("warning"),
    )


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """Top-k per group; Spark keeps only k rows per group before the shuffle (rank limit push-down)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)
