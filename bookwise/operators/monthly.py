"""Purchase history kept up by month: a refresh reads the months that changed, not the history."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookwise.context import months_before
from bookwise.functions.columns import not_other_charge
from bookwise.operators.views import reduce_pg
from bookwise.sources.parts import PartTable
from bookwise.sources.tables import MONTH

#: Tasks, and so files, a month is cut into by customer.
SPREAD = 32
#: Number of the part that holds lines without a day.
UNDATED = 0
_KEYS = ["customer_id", "product_group_id", "product_group_desc"]


def month_number(day: Column | str) -> Column:
    """Months since year 0, ``UNDATED`` for NULL."""
    return F.coalesce(F.year(day) * 12 + F.month(day), F.lit(UNDATED))


def _first_day(number: int) -> date:
    return date((number - 1) // 12, (number - 1) % 12 + 1, 1)


def in_months(sales: DataFrame, numbers: Iterable[int]) -> DataFrame:
    """The lines of the given months; reads no other month where the fact is laid out by month."""
    numbers = sorted(numbers)
    # a month column prunes directories only if it is compared as it is
    month = F.col(MONTH) if MONTH in sales.columns else F.trunc("invoice_date", "MM")
    kept = month.isin([_first_day(n) for n in numbers if n != UNDATED])
    return sales.where(kept | month.isNull() if UNDATED in numbers else kept)


def month_sums(sales: DataFrame) -> DataFrame:
    """Mergeable state per month, customer, group and group name: sums, counts and the extreme days.

    The month and the customer are in the key, so lines combine before the shuffle
    and a customer with a third of them spreads over its months and groups.
    """
    goods = not_other_charge()
    return sales.groupBy(month_number("invoice_date").alias("month"), *_KEYS).agg(
        F.sum(F.when(goods, F.col("extended_price"))).alias("sales"),
        F.count_if(goods).alias("lines"),
        F.count(F.lit(1)).alias("any_lines"),
        F.min(F.when(goods, F.col("invoice_date"))).alias("first_goods"),
        F.max(F.when(goods, F.col("invoice_date"))).alias("last_goods"),
        F.min("invoice_date").alias("first_line"),
    )


class MonthlyHistory:
    """The monthly state on disk, one part per month.

    ``customer_pg`` of any day comes from it: whole months from the state, and the
    month in which the twelve months begin from that month's lines, so it is exact to
    the day. State and lines of a month are replaced together, hence credits, late
    lines and deletions all come out as in a full build.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "history"):
        self._table = PartTable(spark, root, name)

    @classmethod
    def build(cls, sales: DataFrame, root: str, name: str = "history") -> MonthlyHistory:
        """From all lines; needed once."""
        PartTable.create(month_sums(sales), root, name, F.col("month"), _spread())
        return cls(sales.sparkSession, root, name)

    def changed_months(self, sales: DataFrame) -> list[int]:
        """Months whose number of lines is not the stored one, and the newest stored month.

        The lines are counted by day alone, where the fact is laid out by month by its
        directories and file footers alone. A line that changed in place, in a month with
        as many lines as before, does not show; name such months to ``refresh``.
        """
        of_lines = month_number(MONTH if MONTH in sales.columns else "invoice_date")
        now = sales.groupBy(of_lines.alias("month")).agg(F.count(F.lit(1)).alias("now"))
        then = self._table.read().groupBy("month").agg(F.sum("any_lines").alias("then"))
        differ = now.join(then, "month", "full").where(~F.col("now").eqNullSafe(F.col("then"))).select("month").collect()
        return sorted({r["month"] for r in differ} | set(self._table.parts[-1:]))

    def refresh(self, sales: DataFrame, also: Iterable[date] = ()) -> list[int]:
        """Rebuild the months that changed, and those of the days ``also``; returns their numbers."""
        months = sorted({*self.changed_months(sales), *(d.year * 12 + d.month for d in also)})
        self._table = self._table.replace(month_sums(in_months(sales, months)), months, F.col("month"), _spread())
        return months

    def customer_pg(self, sales: DataFrame, as_of: date | str | None = None) -> DataFrame:
        """``views.customer_pg`` of the lines the state was made of; reads one month of ``sales``."""
        spark = sales.sparkSession
        begin = spark.range(1).select(months_before(as_of, 12)).first()[0]
        edge = begin.year * 12 + begin.month
        state = self._table.read()
        none = F.lit(0).cast("bigint")
        whole = F.col("month") > edge
        from_state = state.select(
            *_KEYS,
            F.when(whole, F.col("sales")).alias("sales_12m"),
            F.when(whole, F.col("lines")).otherwise(none).alias("lines_12m"),
            F.when(whole, F.col("any_lines")).otherwise(none).alias("any_lines_12m"),
            F.col("sales").alias("sales_ltd"), F.col("lines").alias("lines_ltd"),
            F.col("first_goods").alias("first_invoice_date"), F.col("last_goods").alias("last_invoice_date"),
            F.col("first_line").alias("first_line_date"),
        )
        # what the first month adds to the twelve months; its lifetime part is in the state
        begun = month_sums(in_months(sales, [edge]).where(F.col("invoice_date") >= F.lit(begin)))
        no_day = F.lit(None).cast("date")
        from_edge = begun.select(
            *_KEYS,
            F.col("sales").alias("sales_12m"), F.col("lines").alias("lines_12m"), F.col("any_lines").alias("any_lines_12m"),
            F.lit(None).cast(state.schema["sales"].dataType).alias("sales_ltd"), none.alias("lines_ltd"),
            no_day.alias("first_invoice_date"), no_day.alias("last_invoice_date"), no_day.alias("first_line_date"),
        )
        kind = state.schema["sales"].dataType
        sums = from_state.unionByName(from_edge).groupBy(*_KEYS).agg(
            F.sum("sales_12m").cast(kind).alias("sales_12m"),
            F.sum("lines_12m").alias("lines_12m"),
            F.sum("any_lines_12m").alias("any_lines_12m"),
            F.sum("sales_ltd").cast(kind).alias("sales_ltd"),
            F.sum("lines_ltd").alias("lines_ltd"),
            F.min("first_invoice_date").alias("first_invoice_date"),
            F.max("last_invoice_date").alias("last_invoice_date"),
            F.min("first_line_date").alias("first_line_date"),
        )
        return reduce_pg(sums)


def _spread() -> list[Column]:
    return [F.pmod(F.xxhash64("customer_id"), F.lit(SPREAD))]
