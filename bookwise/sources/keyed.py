"""Keyed tables on disk: upsert, insert-if-absent and key changes that rewrite only the buckets they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookwise.functions.columns import top_rows
from bookwise.functions.staging import stage
from bookwise.sources import sinks
from bookwise.sources.parts import PartTable


class KeyedTable:
    """A table with a unique key, hashed on it into buckets of one file each.

    A change first collapses to one row per key, then meets only the buckets its keys
    hash to; the others keep their files. The number of buckets is fixed when the
    table is created: choose it so that a bucket fits a task. The rows are those of
    the functions in ``sinks`` on the whole table.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self._table = PartTable(spark, root, name)
        self.keys: list[str] = self._table.extra["keys"]
        self.fold: bool = self._table.extra["fold"]
        self.buckets: int = self._table.extra["buckets"]

    @classmethod
    def create(cls, df: DataFrame, root: str, name: str, keys: list[str], buckets: int, fold: bool = False) -> KeyedTable:
        """Store ``df``. With ``fold`` text keys are stored in lower case, trimmed; of rows that then agree the first stays."""
        rows = top_rows(sinks.folded(keys, True, df), keys, [F.col(c) for c in df.columns], 1) if fold else df
        extra = {"keys": keys, "fold": fold, "buckets": buckets}
        PartTable.create(rows.select(*df.columns), root, name, _bucket(keys, buckets), extra=extra)
        return cls(df.sparkSession, root, name)

    def read(self) -> DataFrame:
        return self._table.read()

    def _buckets_of(self, *rows: DataFrame) -> list[int]:
        """The buckets the keys of ``rows`` hash to; at most as many as there are."""
        numbers = [r.select(_bucket(self.keys, self.buckets).alias("bucket")) for r in rows]
        every = numbers[0] if len(numbers) == 1 else numbers[0].unionByName(numbers[1])
        return sorted(r["bucket"] for r in every.distinct().collect())

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        self._table = self._table.replace(rows, touched, _bucket(self.keys, self.buckets))

    def upsert(self, changes: DataFrame, order: list[Column], stamps: dict[str, Column]) -> list[int]:
        """``sinks.upsert`` in place; returns the buckets that were rewritten."""
        latest = top_rows(sinks.folded(self.keys, self.fold, changes), self.keys, order, 1).withColumns(stamps)
        latest = stage(latest.select(*self._table.schema.names), "changes")
        touched = self._buckets_of(latest)
        old = self._table.read(touched)
        self._replace(old.join(latest.select(*self.keys), self.keys, "left_anti").unionByName(latest), touched)
        return touched

    def seed(self, seeds: DataFrame) -> list[int]:
        """``sinks.seed_if_absent`` in place; seeds that are stored already rewrite nothing."""
        columns = self._table.schema.names
        asked = sinks.folded(self.keys, self.fold, seeds.select(*columns)).select(*columns)
        first = stage(top_rows(asked, self.keys, [F.col(c) for c in columns], 1), "seeds")
        stored = self._table.read(self._buckets_of(first)).select(*self.keys)
        new = stage(first.join(stored, self.keys, "left_anti"), "new-seeds")
        touched = self._buckets_of(new)
        self._replace(self._table.read(touched).unionByName(new), touched)
        return touched

    def rename(self, mapping: DataFrame) -> list[int]:
        """``sinks.key_remap`` in place, for a key of one column; (old, new) pairs, as far as they keep the key unique."""
        if len(self.keys) != 1:
            raise ValueError("keys of one column only")
        key = self.keys[0]
        asked = sinks.folded(["old", "new"], self.fold, mapping.select("old", "new"))
        asked = stage(asked.where("old IS NOT NULL AND new IS NOT NULL").distinct(), "renames")

        def keyed(rows: DataFrame, side: str) -> DataFrame:
            return rows.select(F.col(side).alias(key))

        near = self._table.read(self._buckets_of(keyed(asked, "old"), keyed(asked, "new")))
        usable = stage(sinks.usable_renames(near.select(key), asked, key).where("usable").select("old", "new"), "usable")
        touched = self._buckets_of(keyed(usable, "old"), keyed(usable, "new"))
        to = usable.select(F.col("old").alias(key), F.col("new").alias("_new"))
        moved = self._table.read(touched).join(to, key, "left").withColumn(key, F.coalesce("_new", key))
        self._replace(moved.select(*self._table.schema.names), touched)
        return touched

    def drop_unused(self) -> int:
        return self._table.drop_unused()


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
