"""One roll-up by case that all distinct counts of cases share.

Lines are first summed by case, hospital, month and period (combined map-side, so a case of very many lines is a few rows). Then
the rows of a case come together once, and in each level of the lattice the first row of a case is marked. The number of distinct
cases at a level is the sum of its marks: no question sorts or shuffles cases again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockwarden.functions.dates import month_key
from stockwarden.operators.features import is_volatile
from stockwarden.operators.patterns import days_before, last_moment
from stockwarden.session import materialize

#: Level -> what tells its groups apart, beside the case.
LEVELS = {"all": (), "month": ("month",), "hospital": ("hospital",), "hospital_month": ("hospital", "month"), "hospital_period": ("hospital", "period")}
SUMS = ("qty", "amount", "volatile_qty", "lines")


#: Rows of cases one task sorts, about; more rows make more tasks, so its memory does not grow with the table.
TASK_ROWS = 1_000_000


def case_lattice(lines: DataFrame, days: int = 30) -> DataFrame:
    """Sums by case, hospital, month and period (`now`: the last `days`, `before`: as many before them, `older`), with a mark per level.

    A line without a case counts in the sums and is no case.
    """
    c = F.col
    now, before = c("ts") > days_before(c("today"), days), c("ts") > days_before(c("today"), 2 * days)
    rows = lines.withColumn("today", last_moment(lines)).withColumns({
        "month": month_key(c("ts")), "period": F.when(now, "now").when(before, "before").otherwise("older"), "volatile_qty": F.when(is_volatile(), c("qty")).otherwise(0.0)})
    summed = materialize(rows.groupBy("case_no", "hospital", "month", "period").agg(*[F.sum(x).alias(x) for x in SUMS[:-1]], F.count("*").alias("lines")), "case-sums")
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-summed.count() // TASK_ROWS))
    together = summed.repartition(tasks, "case_no").withColumn("_age", F.when(c("period") == "now", 2).when(c("period") == "before", 1).otherwise(0))
    # In this order every level but the month is a run of rows (periods follow months), so they share sorts: three in all.
    order = ("hospital", "month", "_age")
    place = lambda known: F.row_number().over(Window.partitionBy("case_no", *order[:known]).orderBy(*order[known:])) == 1
    fresh = F.lag("_age").over(Window.partitionBy("case_no", "hospital").orderBy("month", "_age"))
    first = {
        "all": place(0), "hospital": place(1), "hospital_month": place(2), "hospital_period": fresh.isNull() | (fresh != c("_age")),
        "month": F.row_number().over(Window.partitionBy("case_no", "month").orderBy("hospital", "_age")) == 1,
    }
    return together.withColumns({f"case_{name}": F.when(c("case_no").isNotNull() & x, 1).otherwise(0) for name, x in first.items()}).drop("_age")


def rolled_up(lattice: DataFrame, level: str, sums: tuple[str, ...] = SUMS) -> DataFrame:
    """Sums and distinct cases by the columns of a level."""
    return lattice.groupBy(*LEVELS[level]).agg(*[F.sum(x).alias(x) for x in sums], F.coalesce(F.sum(f"case_{level}"), F.lit(0)).alias("cases"))


def monthly_cases(lattice: DataFrame) -> DataFrame:
    """Amount, cases, lines and volatile quantity by month."""
    return rolled_up(lattice, "month").select("month", "amount", "cases", "lines", F.col("volatile_qty").alias("volatile_ml"))


def compared_hospitals(lattice: DataFrame) -> DataFrame:
    """The last period against the one before, by hospital; a hospital without a name drops out."""
    c = F.col
    by_period = rolled_up(lattice.filter("hospital <> ''"), "hospital_period", ("amount",))
    side = lambda x, p: F.coalesce(F.sum(F.when(c("period") == p, c(x))), F.lit(0 if x == "cases" else 0.0))
    out = by_period.groupBy("hospital").agg(side("amount", "now").alias("amount"), side("amount", "before").alias("amount_prev"), side("cases", "now").alias("cases"), side("cases", "before").alias("cases_prev"))
    return out.select(
        "*", F.when(c("amount_prev") != 0, 100 * (c("amount") / c("amount_prev") - 1)).alias("change_pct"), F.when(c("cases") > 0, c("amount") / c("cases")).alias("amount_per_case"),
        F.when(c("cases_prev") > 0, c("amount_prev") / c("cases_prev")).alias("amount_per_case_prev"))


def whole_overview(lattice: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines, cases, products, hospitals and sums of everything."""
    products = lines.agg(F.count_distinct("product_id")).scalar()
    hospitals = lattice.agg(F.count_distinct("hospital")).scalar()
    return rolled_up(lattice, "all", ("qty", "amount", "lines")).select("lines", "cases", products.alias("products"), hospitals.alias("hospitals"), "qty", "amount")
