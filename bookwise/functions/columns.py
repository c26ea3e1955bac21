"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def blank_to_null(col: Column | str) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def full_name(first: Column | str, last: Column | str) -> Column:
    joined = F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))
    return blank_to_null(joined)


def not_other_charge() -> Column:
    """Keep lines whose flag is anything but 'Y', a NULL flag included."""
    return F.coalesce(F.col("other_charge_item"), F.lit("N")) != "Y"


def distinct_values(col: str) -> Column:
    """Aggregate: sorted distinct values, one trailing NULL if any input was NULL.

    ``collect_set`` deduplicates on the map side; the columns used hold dimension
    values (product groups), so an array never outgrows that dimension.
    """
    values = F.array_sort(F.collect_set(col))
    with_null = F.array_append(values, F.lit(None).cast("string"))
    return F.when(F.max(F.col(col).isNull()), with_null).otherwise(values)


def distinct_non_null(col: str) -> Column:
    """Aggregate: sorted distinct non-NULL values, NULL when there are none."""
    values = F.array_sort(F.collect_set(col))
    return F.when(F.size(values) > 0, values)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group.

    The ``rank <= n`` filter lets Spark keep n rows per group and task before the
    shuffle, so a hot group costs no more than a cold one.
    """
    number = rank or "_row"
    ranked = df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(number) <= n)
    return kept if rank else kept.drop(number)


def restrict(df: DataFrame, subjects: DataFrame | None, key: str = "customer_id") -> DataFrame:
    """Rows of the given subjects only; None keeps all."""
    if subjects is None:
        return df
    return df.join(subjects.select(F.col("customer_id").alias(key)), key, "left_semi")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in exact decimals; NULL for an empty whole."""
    hundredfold = (part.cast("decimal(19,0)") * F.lit(100)).cast("decimal(22,0)")
    return F.try_divide(hundredfold, whole.cast("decimal(19,0)"))


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else int(value)))
