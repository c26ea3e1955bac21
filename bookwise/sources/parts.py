"""Tables kept as parts, of which a change rewrites only those it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bookwise.sources import tables

PART = "_part"


class PartTable:
    """A table whose rows belong to numbered parts, one directory each.

    The table's pointer holds the manifest: the schema, and for each part the write
    that made its current files. A change writes the touched parts beside the old ones
    and then switches the pointer by one rename, so a reader sees all of a change or
    nothing of it, and untouched parts are neither read nor written. The driver holds
    one short entry per part; choose parts so that there are at most some ten thousand.

    One writer at a time: a write that finds another one's pointer is refused.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        text = tables.pointed(spark, self.root, name)
        if text is None:
            raise FileNotFoundError(f"no part table {self.root}/{name}")
        self._seen = text
        manifest = json.loads(text)
        self.schema = T.StructType.fromJson(manifest["schema"])
        self.extra: dict = manifest["extra"]
        self._made = {int(part): write for part, write in manifest["parts"].items()}

    @classmethod
    def create(cls, df: DataFrame, root: str, name: str, part: Column, spread: Iterable[Column] = (), extra: dict | None = None) -> PartTable:
        """Write all of ``df``; ``part`` numbers a row's part, ``spread`` cuts a large part into several tasks."""
        write, found = _write(df, f"{root.rstrip('/')}/{name}", part, spread)
        manifest = {"schema": df.schema.jsonValue(), "extra": extra or {}, "parts": {p: write for p in found}}
        tables.point_to(df.sparkSession, root, name, json.dumps(manifest))
        return cls(df.sparkSession, root, name)

    @property
    def parts(self) -> list[int]:
        return sorted(self._made)

    def read(self, parts: Iterable[int] | None = None) -> DataFrame:
        """The rows of the given parts, or of all, as they were when this object was made."""
        wanted = self.parts if parts is None else [p for p in parts if p in self._made]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{self.name}/{self._made[p]}/{PART}={p}" for p in wanted])

    def replace(self, df: DataFrame, touched: Iterable[int], part: Column, spread: Iterable[Column] = ()) -> PartTable:
        """Put ``df`` in the place of all rows of the ``touched`` parts; rows outside them are refused."""
        touched = set(touched)
        if not touched:
            return self
        write, found = _write(df.select(*self.schema.names), f"{self.root}/{self.name}", part, spread)
        if stray := set(found) - touched:
            raise ValueError(f"rows of parts that are not replaced: {sorted(stray)[:5]}")
        made = {p: w for p, w in self._made.items() if p not in touched} | {p: write for p in found}
        if tables.pointed(self.spark, self.root, self.name) != self._seen:
            raise RuntimeError(f"{self.root}/{self.name} was changed by another writer")
        manifest = {"schema": self.schema.jsonValue(), "extra": self.extra, "parts": made}
        tables.point_to(self.spark, self.root, self.name, json.dumps(manifest))
        return PartTable(self.spark, self.root, self.name)

    def drop_unused(self) -> int:
        """Delete the part directories no current part lives in; run it when readers of older states are done."""
        kept, dropped = {f"{w}/{PART}={p}" for p, w in self._made.items()}, 0
        table, files = tables.file_system(self.spark, f"{self.root}/{self.name}")
        for write in [s.getPath() for s in files.listStatus(table) if s.isDirectory()]:
            inside = [s.getPath() for s in files.listStatus(write) if s.isDirectory()]
            stale = [p for p in inside if f"{write.getName()}/{p.getName()}" not in kept]
            for path in [write] if len(stale) == len(inside) else stale:
                files.delete(path, True)
            dropped += len(stale)
        return dropped


def _write(df: DataFrame, table: str, part: Column, spread: Iterable[Column]) -> tuple[str, list[int]]:
    """Write ``df`` as one directory per part; the parts are read off the directories that came to be."""
    write = f"write-{uuid.uuid4().hex}"
    numbered = df.withColumn(PART, part.cast("int"))
    numbered.repartition(F.col(PART), *spread).write.partitionBy(PART).parquet(f"{table}/{write}")
    path, files = tables.file_system(df.sparkSession, f"{table}/{write}")
    names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
    return write, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{PART}="))
