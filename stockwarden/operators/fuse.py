"""Hits to findings: one explainable score per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockwarden.config import CRITICAL_RULES, METHOD_ORDER, ConsumptionConfig
from stockwarden.functions.text import line_fingerprint
from stockwarden.operators import sieve
from stockwarden.session import materialize


def severity(score: Column, critical: Column) -> Column:
    return (
        F.when(critical | (score >= 6), "critical").when(score >= 3.5, "high").when(score >= 2, "medium").otherwise("low")
    )


def scored_lines(hits: DataFrame) -> DataFrame:
    """Points per line: every method adds up, the z family counts once with its largest contribution."""
    is_z = F.startswith(F.col("method"), F.lit("z_"))
    order = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), F.col("method"))
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), "method", "reason")))
    return (
        hits.groupBy("line_id")
        .agg(
            F.coalesce(F.sum(F.when(~is_z, F.col("points"))), F.lit(0.0)).alias("rule_points"),
            F.coalesce(F.max(F.when(is_z, F.col("points"))), F.lit(0.0)).alias("z_points"),
            F.min_by("expected", F.when(F.col("expected").isNotNull(), F.col("priority"))).alias("expected"),
            F.bool_or(F.col("method").isin(*CRITICAL_RULES)).alias("critical"),
            listed.alias("listed"),
        )
        .select(
            "line_id", (F.col("rule_points") + F.col("z_points")).alias("score"), "expected", "critical",
            F.transform("listed", lambda x: x["method"]).alias("methods"), F.transform("listed", lambda x: x["reason"]).alias("reasons"),
        )
    )


def findings(lines: DataFrame, hits: DataFrame, cfg: ConsumptionConfig, justified: DataFrame | None = None) -> DataFrame:
    """Lines with a score of 2 or a critical rule, unless people already justified the same fingerprint.

    Scores exist only for lines with a hit; their table is far smaller than the lines it is joined back to.
    """
    c = F.col
    kept = materialize(scored_lines(hits).filter((c("score") >= 2.0) | c("critical")), "scored-lines")
    near = sieve.may_match(lines, sieve.bitmap(kept, "line_id"), "line_id", "_near").filter("_near").drop("_near")
    rows = near.join(kept, "line_id").withColumn(
        "fingerprint", line_fingerprint(c("case_no"), c("product_id"), c("qty"), c("ts"), c("lot")))
    if justified is not None:
        rows = rows.join(justified.select("fingerprint"), "fingerprint", "left_anti")
    deviation = c("qty") - c("expected")
    money = F.when(c("expected").isNotNull(), F.greatest(F.lit(0.0), deviation) * c("unit_cost")).otherwise(c("amount") * 0.5)
    return rows.select(
        "line_id", "ts", "case_id", "case_no", "hospital", "doctor", "technician", "sublocation", "warehouse", "product_id", "product",
        "lot", "qty", "unit", "expected", deviation.alias("deviation"), money.alias("risk_amount"), "score",
        severity(c("score"), c("critical")).alias("severity"), "methods", "reasons", "fingerprint", "duration_min", "rate",
        "weight_start", "weight_end", "amount",
    )


def count_by_method(found: DataFrame) -> DataFrame:
    return found.select(F.explode("methods").alias("method")).groupBy("method").agg(F.count("*").alias("findings"))


def ranked(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), F.desc("risk_amount"), "line_id")


def unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose fingerprint no earlier run stored."""
    return found.join(known.select("fingerprint"), "fingerprint", "left_anti")


def recurring(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("fingerprint"), "fingerprint", "left_semi")


def money_by_status(found: DataFrame) -> DataFrame:
    """Money under review, confirmed and cleared."""
    groups = {"review": ("new", "reviewed"), "confirmed": ("confirmed",), "cleared": ("justified", "discarded")}
    aggs = []
    for name, states in groups.items():
        inside = F.col("status").isin(*states)
        aggs += [F.coalesce(F.sum(F.when(inside, F.col("risk_amount"))), F.lit(0.0)).alias(name), F.count_if(inside).alias(f"n_{name}")]
    return found.agg(*aggs)


def run_kpis(lines: DataFrame, found: DataFrame, patterns: DataFrame) -> DataFrame:
    counts = found.agg(
        F.count("*").alias("findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")],
        F.coalesce(F.sum("risk_amount"), F.lit(0.0)).alias("risk_amount"),
    )
    pattern_counts = patterns.agg(F.count("*").alias("n"), F.coalesce(F.sum("risk_amount"), F.lit(0.0)).alias("m"))
    return counts.select(
        lines.agg(F.count("*")).scalar().alias("lines"), "*", pattern_counts.select("n").scalar().alias("patterns"),
        pattern_counts.select("m").scalar().alias("pattern_amount"),
    )
