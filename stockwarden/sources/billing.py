"""Customer and supplier invoices."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockwarden.functions.dates import month_key

SIDES = {"customer": ("out_invoice", "out_refund"), "supplier": ("in_invoice", "in_refund")}


def invoices(moves: DataFrame, start: date, end: date, as_of: date, side: str = "customer") -> DataFrame:
    """Not cancelled, dated in the window; overdue is judged before refunds turn the amounts negative."""
    sign = F.when(F.endswith(F.col("kind"), F.lit("refund")), -1.0).otherwise(1.0)
    overdue = (F.col("due") < F.lit(as_of)) & (F.col("balance") > 0) & (F.col("state") == "posted")
    return (
        moves.filter(F.col("kind").isin(*SIDES[side]) & F.col("date").between(F.lit(start), F.lit(end)) & (F.col("state") != "cancel"))
        .select(
            "number", "customer", "date", "due", "state", "payment_state", "kind",
            *[(F.coalesce(F.col(c), F.lit(0.0)) * sign).alias(c) for c in ("subtotal", "total", "balance")],
            F.coalesce(overdue, F.lit(False)).alias("overdue"), month_key(F.col("date")).alias("month"),
        )
    )


def invoice_lines(lines: DataFrame, start: date, end: date, side: str = "customer") -> DataFrame:
    return (
        lines.filter(F.col("kind").isin(*SIDES[side]) & F.col("date").between(F.lit(start), F.lit(end))
                     & (F.col("state") != "cancel") & F.col("product_id").isNotNull())
        .select("number", "customer", "product_id", "qty", "unit_price", "amount", "date", month_key(F.col("date")).alias("month"))
    )


def billing_totals(invoice_table: DataFrame) -> DataFrame:
    posted = F.col("state") == "posted"
    billed, receivable = F.sum(F.when(posted, F.col("total"))), F.sum(F.when(posted, F.col("balance")))
    zero = F.lit(0.0)
    return invoice_table.agg(
        F.count_if(posted).alias("invoices"),
        F.count_if(F.col("state") == "draft").alias("drafts"),
        F.coalesce(billed, zero).alias("billed"),
        (F.coalesce(billed, zero) - F.coalesce(receivable, zero)).alias("collected"),
        F.coalesce(receivable, zero).alias("receivable"),
        F.coalesce(F.sum(F.when(posted & F.col("overdue"), F.col("balance"))), zero).alias("overdue"),
        F.count_if(posted & F.col("overdue")).alias("overdue_invoices"),
    )


def top_customers(invoice_table: DataFrame, n: int = 10) -> DataFrame:
    return (
        invoice_table.filter("state = 'posted'").groupBy("customer")
        .agg(F.sum("total").alias("total"), F.sum("balance").alias("balance"))
        .orderBy(F.desc("total"), "customer").limit(n)
    )


def billing_by_month(invoice_table: DataFrame) -> DataFrame:
    return invoice_table.filter("state = 'posted'").groupBy("month").agg(F.sum("total").alias("total"), F.sum("balance").alias("balance"))
