"""Source divergence audit: term counts by Arrow kernels, divergences on columnar shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.batches import SLICE_BYTES, give_back
from bookwise.llm.common import small, table

#: What stands between two terms.
SEPARATOR = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept if at least this many documents of its language hold it.
MIN_DOCUMENTS = 30
SMOOTHING = 5
#: Shares are whole multiples of 1 / 10**9, built three decimal digits at a time.
DIGIT_GROUPS = 3
#: Ranks of the part ``term``.
TERMS = 50
#: Kept counts in a shard, and cells of the dense block a shard works on at a time.
SHARD_ROWS = 100_000
CELLS = 1 << 20
#: Partial counts a task holds before it sends them on.
HOLD_ROWS = 1 << 19

_GROUP = ["lang", "source"]
_COUNTS = "lang string, source string, term string, n long, docs long"


def _slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes of text; one longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def partial_counts(part: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of every term by (lang, source); the empty term stands for the group itself."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), pattern=SEPARATOR)
    rows, terms = pc.list_parent_indices(pieces), pc.list_flatten(pieces)
    real = pc.not_equal(terms, "")
    rows, terms = rows.filter(real), terms.filter(real).dictionary_encode()
    one = pa.table({"row": rows, "term": terms.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    held = pa.table(
        {
            "lang": part.column("lang").take(one["row"]),
            "source": part.column("source").take(one["row"]),
            "term": terms.dictionary.take(one["term"]),
            "n": one["count_all"],
            "docs": pa.repeat(pa.scalar(1, pa.int64()), one.num_rows),
        }
    )
    none = pa.repeat(pa.scalar(0, pa.int64()), part.num_rows)
    groups = pa.table({"lang": part.column("lang"), "source": part.column("source"), "term": pa.repeat(pa.scalar(""), part.num_rows), "n": none, "docs": none})
    return _summed([held, groups])


def _summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by([*_GROUP, "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return whole.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select([*_GROUP, "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for part in _slices(batch):
            held.append(partial_counts(part))
            if sum(t.num_rows for t in held) > HOLD_ROWS:
                held = [_summed(held)]
                if held[0].num_rows > HOLD_ROWS // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held:
        yield from _summed(held).to_batches(max_chunksize=1 << 16)
    give_back()


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exact in 64 bits for totals below 9 * 10**15."""
    whole = total.astype(np.int64) + SMOOTHING * terms
    rest, share = counts.astype(np.int64) + SMOOTHING, 0
    for _ in range(DIGIT_GROUPS):
        rest = rest * 1000
        share = share * 1000 + rest // whole
        rest = rest % whole
    return share + 1


def _first(values: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` largest values, equal ones by term number."""
    return np.lexsort((terms, -values))[:n]


def divergences(kept: pa.Table, groups: pa.Table) -> pa.Table:
    """What one shard's terms add to the distances of its language's sources, and the shard's first terms of each source."""
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
    if not kept.num_rows:
        return pa.table({"lang": [], **out}, pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))
    sources = groups["source"].to_pylist()
    number = {s: i for i, s in enumerate(sources)}
    totals = groups["total"].to_numpy().astype(np.int64)
    vocabulary, lang = int(groups["terms"][0].as_py()), groups["lang"][0].as_py()
    names = pc.unique(kept["term"]).to_pylist()
    names.sort(key=str.encode)
    index = {t: i for i, t in enumerate(names)}
    row = np.fromiter(map(index.__getitem__, kept["term"].to_pylist()), np.int64, kept.num_rows)
    column = np.fromiter(map(number.__getitem__, kept["source"].to_pylist()), np.int64, kept.num_rows)
    order = np.argsort(row, kind="stable")
    row, column, n = row[order], column[order], kept["n"].to_numpy()[order]

    apart = np.zeros((len(sources), len(sources)), np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in sources]
    height = max(1, CELLS // len(sources))
    for low in range(0, len(names), height):
        high = min(len(names), low + height)
        at, to = np.searchsorted(row, [low, high])
        counts = np.zeros((len(sources), high - low), np.int64)
        counts[column[at:to], row[at:to] - low] = n[at:to]
        market = shares(counts.sum(0), totals.sum(keepdims=True), vocabulary)
        own = shares(counts, totals[:, None], vocabulary)
        for i in range(len(sources)):
            apart[i, i + 1 :] += np.abs(own[i + 1 :] - own[i]).sum(1)
            above = np.flatnonzero((counts[i] > 0) & (own[i] > market))
            values = np.concatenate([best[i][0], (own[i] - market)[above]])
            terms = np.concatenate([best[i][1], above + low])
            first = _first(values, terms, TERMS)
            best[i] = values[first], terms[first]
    for i, source in enumerate(sources):
        for j in range(i + 1, len(sources)):
            out["source"].append(source), out["part"].append("pair"), out["item"].append(sources[j]), out["value"].append(int(apart[i, j]))
        for value, term in zip(*best[i]):
            out["source"].append(source), out["part"].append("term"), out["item"].append(names[term]), out["value"].append(int(value))
    return pa.table({"lang": pa.repeat(pa.scalar(lang), len(out["value"])), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()),
                     "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language differ, and by which terms.

    Part ``pair`` has a row for every other source of the language: the sum of the
    absolute differences of both sources' shares over all kept terms. Part ``term``
    has at most 50 rows for a source: terms it uses more than its language does.
    Null text, lang and source are read as ''; a group without terms still has its
    pairs, and a language without kept terms has distances of 0; an empty table
    gives no rows. Repeated rows count each for itself, other columns are never
    read. Ranks start at 1, larger values first, ties in the items' UTF-8 order.
    """
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*_GROUP, "text")))
    partial = read.mapInArrow(_count, _COUNTS)
    counts = stage(partial.groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    spread = Window.partitionBy("lang", "term")
    kept = counts.where("term <> ''").withColumn("spread", F.sum("docs").over(spread)).where(F.col("spread") >= min_documents)
    kept = stage(kept.select(*_GROUP, "term", "n"), "divergence-kept")

    totals = kept.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = counts.where("term = ''").select(*_GROUP).join(totals, _GROUP, "left").join(vocabulary, "lang", "left")
    groups = stage(groups.select(*_GROUP, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms"))), "divergence-groups")

    shards = max(16, -(-kept.count() // SHARD_ROWS))
    cut = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    everywhere = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = cut.groupBy("lang", "shard").cogroup(everywhere.groupBy("lang", "shard"))
    found = stage(found.applyInArrow(divergences, "lang string, source string, part string, item string, value long"), "divergence-shards")

    half = found.where("part = 'pair'").groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))
    both = half.unionAll(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = small(groups.select("lang", F.col("source").alias("item")), groups.count())
    every = groups.select(*_GROUP).join(other, "lang").where("source <> item")
    pairs = every.join(both, [*_GROUP, "item"], "left").select(*_GROUP, F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERMS)
    return pairs.withColumn("rank", F.row_number().over(order)).unionAll(terms.select(*_GROUP, "part", "item", "value", "rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language and the terms that set a source apart."""
    return audit(table(spark, sf_dir, "documents", "lang", "source", "text"))
