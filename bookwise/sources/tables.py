"""Typed parquet sources and the write layout of the fact tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookwise import schemas

MONTH = "fact_month"


class Tables:
    """The synced ERP tables and the owned lookups, ids already cast to string.

    Each table is built on first use, so an operator pays for the tables it reads.
    """

    customers: DataFrame
    salesreps: DataFrame
    invoice_sales: DataFrame
    open_quotes: DataFrame
    open_orders: DataFrame
    cancelled_quotes: DataFrame
    erp_users: DataFrame
    activity_trans: DataFrame
    user_access: DataFrame
    list_settings: DataFrame
    task_type: DataFrame
    task_outbox: DataFrame

    def __init__(self, **loaders: Callable[[], DataFrame]):
        unknown = set(loaders) - set(schemas.TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._loaders = loaders

    def __getattr__(self, name: str) -> DataFrame:
        # reached only while the table is not cached as an attribute
        loaders = self.__dict__.get("_loaders", {})
        if name not in loaders:
            raise AttributeError(name)
        table = loaders[name]()
        setattr(self, name, table)
        return table


def load(spark: SparkSession, root: str) -> Tables:
    """Read every table from ``root/<name>`` with its fixed schema, no inference."""
    return Tables(**{name: partial(read_table, spark, root, name) for name in schemas.TABLES})


#: Names the version of a table that readers see.
POINTER = "_current"


def file_system(spark: SparkSession, path: str):
    """The path with the file system it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def pointed(spark: SparkSession, root: str, name: str) -> str | None:
    """What the table's pointer says; None without a pointer."""
    pointer, files = file_system(spark, f"{root.rstrip('/')}/{name}/{POINTER}")
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current_path(spark: SparkSession, root: str, name: str) -> str:
    """The directory of the table's current version; the table's own directory where it has no versions."""
    table, version = f"{root.rstrip('/')}/{name}", pointed(spark, root, name)
    return table if version is None else f"{table}/{version}"


def point_to(spark: SparkSession, root: str, name: str, version: str) -> None:
    """Switch readers to ``version``: one rename, which replaces the pointer whole or not at all."""
    target, files = file_system(spark, f"{root.rstrip('/')}/{name}/{POINTER}")
    fresh, _ = file_system(spark, f"{root.rstrip('/')}/{name}/_pointer-{uuid.uuid4().hex}")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(fresh), files.makeQualified(target), options)


def drop_old_versions(spark: SparkSession, root: str, name: str, keep: int = 2) -> int:
    """Delete what readers no longer need: all versions but the current one and the ``keep`` - 1 newest others.

    Run it when every reader of older versions is done. Leftovers of a replace that
    failed are versions as well and go the same way.
    """
    table, files = file_system(spark, f"{root.rstrip('/')}/{name}")
    current = current_path(spark, root, name).rsplit("/", 1)[1]
    found = [s for s in files.listStatus(table) if s.isDirectory() and s.getPath().getName().startswith("version-")]
    others = sorted((s for s in found if s.getPath().getName() != current), key=lambda s: -s.getModificationTime())
    for status in others[max(0, keep - 1) :]:
        files.delete(status.getPath(), True)
    return len(others[max(0, keep - 1) :])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One version of the table: the pointer is read once, here, so a later replace does not touch this reader."""
    schema = schemas.TABLES[name]
    if name in schemas.FACTS:
        schema = type(schema)(list(schema.fields)).add(MONTH, "date")
    return spark.read.schema(schema).parquet(current_path(spark, root, name))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the fixed schema once at load; columns the input lacks become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.TABLES[name].fields
        ]
    )


def replace_table(df: DataFrame, root: str, name: str, files: int | None = None) -> str:
    """Full replace of one table, as each sync does; returns the new version's directory.

    The new version is written beside the old ones and becomes current by one rename
    when it is complete: readers see all of the old or all of the new table, and a
    replace that dies leaves the old one as it was. ``drop_old_versions`` cleans up.

    Facts are laid out by month and, inside a month, clustered by customer, so a
    date window prunes directories and a customer filter prunes row groups. The
    line hash in the range key lets one hot customer span many files.
    """
    version = f"version-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}/{version}"
    typed = conform(df, name)
    if name not in schemas.FACTS:
        typed.write.parquet(path)
    else:
        dated = typed.withColumn(MONTH, F.trunc(schemas.FACTS[name], "MM"))
        keys = [F.col(MONTH), F.col("customer_id"), F.xxhash64("order_no", "line_no", "item_id")]
        spread = dated.repartitionByRange(*([files] if files else []), *keys)
        spread.sortWithinPartitions(MONTH, "customer_id").write.partitionBy(MONTH).parquet(path)
    point_to(df.sparkSession, root, name, version)
    return path


def since(fact: DataFrame, date_col: str, first_day: Column) -> DataFrame:
    """Lines on or after a day (no upper bound); prunes month partitions where there are any."""
    kept = fact.where(F.col(date_col) >= first_day)
    return kept.where(F.col(MONTH) >= F.trunc(first_day, "MM")) if MONTH in fact.columns else kept
