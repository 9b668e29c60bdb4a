"""Reading any stored table under the sensitive-column guard, and writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockwarden.config import GUARDED_COLUMNS, GUARDED_TABLES
from stockwarden.schema import clean_doubles


def is_guarded(column: str) -> bool:
    return any(fragment in column.lower() for fragment in GUARDED_COLUMNS)


def without_guarded(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not is_guarded(c)])


def check_table(name: str) -> None:
    if any(fragment in name for fragment in GUARDED_TABLES):
        raise ValueError(f"table {name} is not open to queries")


def predicate(field: str, op: str, value) -> Column:
    """One (field, operator, value) condition."""
    if is_guarded(field):
        raise ValueError(f"column {field} cannot be used as a filter")
    col = F.col(field)
    if op == "=":
        return col.isNull() if value is None or value is False else col == value
    if op == "!=":
        return col.isNotNull() if value is None or value is False else (col != value) | col.isNull()
    if op == "in":
        return col.isin(list(value))
    if op == "not in":
        return ~F.coalesce(col.isin(list(value)), F.lit(False))
    if op == "ilike":
        return F.coalesce(F.lower(col.cast("string")).contains(str(value).lower()), F.lit(False))
    comparisons = {">": col.__gt__, ">=": col.__ge__, "<": col.__lt__, "<=": col.__le__}
    return comparisons[op](value)


def condition(terms: list) -> Column:
    """Terms are joined by AND; '|' before two terms joins those two by OR (prefix form)."""
    stack: list[Column] = []
    for term in reversed(terms):
        if term == "|":
            stack.append(stack.pop() | stack.pop())
        elif term != "&":
            stack.append(predicate(*term))
        else:
            stack.append(stack.pop() & stack.pop())
    return reduce(lambda a, b: b & a, stack, F.lit(True))


def query_table(df: DataFrame, name: str, terms: list | None = None, fields: list[str] | None = None,
                order: list[Column] | None = None, limit: int | None = None, group_by: list[str] | None = None,
                sums: list[str] | None = None) -> DataFrame:
    """Filtered projection of a table, or grouped sums with a record count; guarded columns never leave. No limit but the caller's."""
    check_table(name)
    rows = df.filter(condition(terms)) if terms else df
    keys = [c for c in group_by or [] if not is_guarded(c)]
    if keys:
        totals = [F.sum(c).alias(c) for c in sums or [] if not is_guarded(c)]
        grouped = rows.groupBy(*keys).agg(*totals, F.count("*").alias("records")).orderBy(*keys)
        return grouped if limit is None else grouped.limit(limit)
    chosen = [c for c in fields or [] if not is_guarded(c)] or ["display_name"]
    rows = rows.select(*chosen) if not order else rows.orderBy(*order).select(*chosen)
    return rows if limit is None else rows.limit(limit)


def append_run(df: DataFrame, run_id: int, path: str) -> None:
    """Append-only sink for findings, forecasts and replenishment, one partition per run."""
    clean_doubles(df).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def merge_profiles(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Statistics come from the fresh run, the learned threshold adjustment is kept from the stored table."""
    keys = ["scope", "key", "metric"]
    statistics = [c for c in fresh.columns if c not in keys and c != "threshold_adj"]
    old, new = stored.alias("o"), fresh.withColumn("_new", F.lit(True)).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    return old.join(new, on, "full_outer").select(
        *[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys],
        *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in statistics],
        F.coalesce("o.threshold_adj", F.lit(0.0)).alias("threshold_adj"),
    )


def json_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})


def parse_json(df: DataFrame, **schemas: T.DataType | str) -> DataFrame:
    """Typed columns from JSON text; malformed text gives NULL."""
    return df.withColumns({c: F.from_json(F.col(c), s, {"mode": "PERMISSIVE"}) for c, s in schemas.items()})


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", max_rows: int | None = None) -> DataFrame:
    """One folder per table plus a manifest that says whether a table is complete.

    Each table is written once and whole; its row count is an observation of that write. Only a caller's `max_rows` cuts, and
    then the manifest has the full count too.
    """
    from pyspark.sql import Observation

    some = next(iter(tables.values()))
    spark: SparkSession = some.sparkSession
    manifest = []
    for name, df in tables.items():
        seen = Observation(f"rows of {name}")
        bounded = (df if max_rows is None else df.limit(max_rows)).observe(seen, F.count(F.lit(1)).alias("n"))
        writer = bounded.write.mode("overwrite")
        (writer.option("header", "true").csv if fmt == "csv" else writer.parquet)(f"{path}/{name}")
        written = seen.get["n"]
        total = written if max_rows is None or written < max_rows else df.count()
        manifest.append((name, written, total, written == total))
    out = spark.createDataFrame(manifest, "name string, rows_written bigint, rows_total bigint, complete boolean")
    out.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return out
