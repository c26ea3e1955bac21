"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that is sent whole to every executor; larger ones are joined by Spark's own choice.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; other columns never enter a plan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds.

    They leave it in Arrow form: plain rows become an RDD that Python workers of its
    own convert on the executors, and those workers stay beside the others.
    """
    names = StructType.fromDDL(schema).names
    columns = zip(*rows) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names), schema)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark a table of ``rows`` rows, counted or bounded by a parameter, for broadcast if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def frequent(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(key): the values that 1,000 rows and one in 100,000 of the ``rows`` rows hold; at most 100,000 values, whatever the data."""
    often = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return often.where(F.col("n") > max(1_000, rows // 100_000)).select(key)


def lookup(df: DataFrame, other: DataFrame, key: str, often: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined to ``other``, which has one slim row per ``key``; the keys in ``often``, as ``frequent`` gives them, do not shuffle.

    Rows of a frequent key stay where they are and meet a broadcast of at most
    100,000 rows; all others meet by Spark's own choice. ``how`` is inner or left.
    """
    few = F.broadcast(often.withColumn("often", F.lit(True)))
    marked = df.join(few, key, "left")
    hot = F.broadcast(other.join(F.broadcast(often), key, "left_semi"))
    rare = marked.where("often IS NULL").drop("often").join(other, key, how)
    return rare.unionAll(marked.where("often").drop("often").join(hot, key, how))


def twins(df: DataFrame) -> DataFrame:
    """``df`` with column ``twin``, which numbers rows that agree in every column.

    Equal rows meet as one counted row and are dealt out again, so that many of
    them never share a task, and every (row, twin) is distinct and repeatable.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("twin_count"))
    return counted.withColumn("twin", F.explode(F.sequence(F.lit(0), F.col("twin_count").cast("int") - 1))).drop("twin_count")


def hash_order(seed: int, *columns: str) -> list[Column]:
    """Two seeded 64-bit hashes: a repeatable random order of distinct rows."""
    return [F.xxhash64(F.lit(seed), *columns), F.xxhash64(F.lit(seed + 1), *columns)]


def ranked(df: DataFrame, group: list[str], order: list[str], groups: int | None = None, bits: int = 8, rank: str = "rank") -> DataFrame:
    """Rank from 0 by ``order`` inside ``group``; ``order[0]`` is a 64-bit hash.

    The top ``bits`` bits of the hash cut each group into slices of about equal
    size. A slice is ranked by itself and starts where the slices before it end,
    so a group of any size is spread over 2**bits tasks. ``groups`` bounds the
    number of groups; the table of slice sizes has at most groups * 2**bits rows.
    """
    cut = df.withColumn("slice", F.shiftrightunsigned(order[0], 64 - bits).cast("int"))
    sizes = cut.groupBy(*group, "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if groups is not None:
        starts = small(starts, groups << bits)
    inside = Window.partitionBy(*group, "slice").orderBy(*order)
    numbered = cut.withColumn("inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [*group, "slice"])
        .withColumn(rank, F.col("start") + F.col("inside"))
        .drop("slice", "start", "inside")
    )


def part_of(ends: Column, rank: Column) -> Column:
    """Index of the interval that holds ``rank``; ``ends`` are the intervals' exclusive ends."""
    return F.size(F.filter(ends, lambda end: end <= rank))
