"""Packing token sequences by minimum bin slack over a histogram of remaining lengths."""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.batches import slices
from bookwise.llm.common import local, small, table, text_or_empty, twins
from bookwise.llm.tokens import encode_all, tokenizer_path

WINDOW = 2048
#: Id that ends every document.
END_ID = 1
SEED = 5_005
#: Slices by which documents of one remaining length are ranked (a power of two).
SLICES = 16


@dataclass
class Interval:
    """Documents of remaining length ``rem`` and rank ``first`` to ``first + n - 1``: one piece of each.

    The piece has ``length`` ids from ``start`` (in the remainder) and goes to
    ``offset`` of sequence ``sequence + rank - first``.
    """

    rem: int
    first: int
    n: int
    start: int
    length: int
    sequence: int
    offset: int


def fullest(counts: Counter, room: int) -> Counter:
    """The multiset of lengths, at most ``counts`` of each, whose sum is nearest to ``room`` and not above it.

    Subset sums are the bits of one integer. A length with k copies is shifted in
    as 1, 2, 4, ... copies; the bits before each shift are kept and lead back from
    the best sum to the copies used. Long lengths come first, and the search ends
    as soon as the room is filled.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, Counter()
    for before, length, copies in reversed(steps):
        if not before >> total & 1:
            used[length] += copies
            total -= length * copies
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> tuple[list[Interval], int]:
    """Where the remainders go, and how many windows they take. ``histogram``: documents by remaining length.

    Each window starts with the longest length left and is filled by ``fullest``.
    The same filling is applied to as many windows as its counts allow, so the
    work depends on the number of lengths, not of documents. If slack stays while
    other documents are left, the longest of them is cut to fill it and its rest
    goes back among the lengths.
    """
    queues: dict[int, deque] = {}
    counts: Counter = Counter()
    for length, n in histogram.items():
        if n and 0 < length < window:
            queues[length] = deque([(length, 0, 0, n)])  # (remainder, first rank, start, documents)
            counts[length] = n
    out: list[Interval] = []
    windows = 0

    def take(length: int, piece: int, times: int, offset: int) -> list[tuple]:
        """Put ``piece`` ids of the next ``times`` items of a length at ``offset`` of the current windows."""
        done, taken = 0, []
        while done < times:
            rem, first, start, n = queues[length].popleft()
            k = min(n, times - done)
            if k < n:
                queues[length].appendleft((rem, first + k, start, n - k))
            out.append(Interval(rem, first, k, start, piece, windows + done, offset))
            taken.append((rem, first, start + piece, k))
            done += k
        counts[length] -= times
        if not counts[length]:
            del counts[length]
        return taken

    while counts:
        longest = max(counts)
        left = counts.copy()
        left[longest] -= 1
        need = fullest(+left, window - longest)
        need[longest] += 1
        slack = window - sum(k * n for k, n in need.items())
        left = +(counts - need)
        cut = max(left, default=0) if slack else 0
        whole = need.copy()
        if cut > slack:
            need[cut] += 1
        else:
            cut = 0
        times = min(counts[k] // n for k, n in need.items())
        offset = 0
        for length, n in sorted(whole.items(), reverse=True):
            for _ in range(n):
                take(length, length, times, offset)
                offset += length
        if cut:
            rests = take(cut, slack, times, offset)
            queues.setdefault(cut - slack, deque()).extend(rests)
            counts[cut - slack] += times
        windows += times
    return out, windows


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def _ids(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text and the end id."""
    for parts in encode_all(path, texts):
        yield np.concatenate([*(np.asarray(p, np.uint32) for p in parts), np.array([END_ID], np.uint32)])


def measured(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, doc_tokens, crcs): length of each document and the checksum of its windows and remainder."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            lengths, crcs = [], []
            for ids in _ids(path, texts):
                lengths.append(len(ids))
                crcs.append([_crc(ids[i : i + window]) for i in range(0, len(ids), window)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "doc_tokens", "crcs"],
            )

    return docs.mapInArrow(measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, doc_tokens long, crcs array<long>")


def _cut_crcs(docs: DataFrame, cuts: DataFrame, n_cuts: int, path: str) -> DataFrame:
    """Checksums of the ``n_cuts`` pieces that cut a remainder, from the text again. ``cuts``: doc_id, text_hash, start, length."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    wanted = cuts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("pieces"))
    wanted = small(wanted, n_cuts)
    same = docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.text_hash == wanted.text_hash)
    # one text for equal rows
    texts = docs.join(wanted, same).select(docs.doc_id, docs.text_hash, "text", "pieces").dropDuplicates(["doc_id", "text_hash"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, whole in slices(batches):
            rows = []
            for doc_id, code, pieces, ids in zip(
                part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), part.column("pieces").to_pylist(), _ids(path, whole)
            ):
                rows += [(doc_id, code, p["start"], p["length"], _crc(ids[p["start"] : p["start"] + p["length"]])) for p in pieces]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], part.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "text_hash", "start", "length", "cut_crc"],
            )

    return texts.mapInArrow(again, f"doc_id {key_type}, text_hash long, start long, length long, cut_crc long")


def pack(docs: DataFrame, path: str, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text (null: empty, which has the end id alone). Whole
    windows of a long document are sequences by themselves. Remainders are
    counted by length; the driver sees that histogram (at most window * SLICES
    rows) and plans the windows on it. Documents find their place by their rank
    among those of the same remaining length, which hash slices spread over tasks,
    so a length that a third of the documents share is no hot key. Equal rows are
    packed each; an empty table gives no rows.

    Text is encoded once for lengths and checksums. Where the plan cuts
    remainders, the few documents concerned are encoded again.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = twins(stage(measured(texts, path, window), "pack-lengths"))
    rows = rows.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "twin"))
    rows = rows.withColumn("rem", (F.col("doc_tokens") % window).cast("int")).withColumn("n_full", F.floor(F.col("doc_tokens") / window))
    rows = rows.withColumn("slice", F.pmod("order", F.lit(SLICES)).cast("int"))
    groups = rows.groupBy("rem", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("full")).collect()
    groups.sort(key=lambda g: (g["rem"], g["slice"]))
    histogram: Counter = Counter()
    for g in groups:
        histogram[g["rem"]] += g["n"]
    intervals, windows = plan_windows(histogram, window)

    starts, seen, full = [], Counter(), windows
    for g in groups:
        starts.append((g["rem"], g["slice"], seen[g["rem"]], full))
        seen[g["rem"]] += g["n"]
        full += g["full"]
    first = local(spark, starts, "rem int, slice int, rank_start long, full_start long")
    inside = Window.partitionBy("rem", "slice").orderBy("order", "doc_id", "text_hash", "twin")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1).withColumn("before", F.sum("n_full").over(inside) - F.col("n_full"))
    placed = stage(
        numbered.join(small(first, len(starts)), ["rem", "slice"]).select(
            "doc_id", "text_hash", "doc_tokens", "crcs", "rem", "n_full",
            (F.col("rank_start") + F.col("at")).alias("rank"), (F.col("full_start") + F.col("before")).alias("full_id"),
        ),
        "pack-ranks",
    )
    whole = placed.where("n_full > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n_full").cast("int") - 1)).alias("i")).select(
        "doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        F.expr("crcs[i]").alias("ids_crc32"), "doc_tokens", (F.col("full_id") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    spots = local(
        spark, [(x.rem, x.first, x.n, x.start, x.length, x.sequence, x.offset) for x in intervals],
        "rem int, first long, n long, at long, length long, sequence long, offset long",
    )
    rest = placed.where("rem > 0").join(small(spots, len(intervals)), "rem").where("rank >= first AND rank < first + n")
    rest = rest.select(
        "doc_id", "text_hash", (F.col("n_full") * window + F.col("at")).alias("start"), "length", F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset",
        (F.col("length") < F.col("rem")).alias("cut"),
    )
    if n_cuts := sum(x.n for x in intervals if x.length < x.rem):
        cut = rest.where("cut")
        codes = _cut_crcs(texts, cut.select("doc_id", "text_hash", "start", "length"), n_cuts, path)
        keys = [cut[k].eqNullSafe(codes[k]) for k in ("doc_id", "text_hash", "start", "length")]
        mended = cut.join(codes, keys).select(*[cut[c] for c in cut.columns if c != "ids_crc32"], codes.cut_crc.alias("ids_crc32"))
        rest = rest.where("NOT cut").unionByName(mended)
    return whole.unionByName(rest.select(*whole.columns))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
