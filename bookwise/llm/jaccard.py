"""N-gram Jaccard self-join by universe partition, pigeonhole and exact verification.

Sets x and y with Jaccard similarity of 0.8 or more differ in at most
H = floor((|x| + |y|) / 9) elements. The hash of an element decides its segment,
the same for all sets of a size band, and the allocation decides what is indexed:

* Short bands have ceil((H + 1) / 2) segments. Similar sets have one segment in
  which they differ by one element at most, so each segment is indexed as it is
  and with every one of its elements deleted. Nothing is indexed that is empty:
  where all that two sets have in common in that segment is emptiness, both hold
  at most one element there, and all such sets are cut anew by another hash.
* Longer bands have m > H segments. Similar sets agree in m - H segments or more.
  By cost, a set leaves out the m - H - 1 segments that most other sets share:
  empty ones first, then by how many sets hold the same value. All sets rank
  values alike, so the rarest value two similar sets share is left out by neither.

A set is indexed under its own band and under the next one if that can hold a
partner. Values that one set alone holds never leave the first shuffle. Sets that
share passages with many others leave those values out; what remains in crowded
buckets are near copies, which meet the one set that shares most first and, where
that leaves them in different components, all others, block by block. Every link
is verified on its words.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.batches import SHORT_SLICE_BYTES, give_back, numbered, slices
from bookwise.llm.common import WORD, frequent, lookup, small, table, text_or_empty
from bookwise.llm.components import connected

WIDTH = 5
#: Jaccard similarity of a link, in percent.
PERCENT = 80
#: Growth of the size bands; above 1.25, so that partners are in the same or the next band.
GROWTH = 1.6
#: Bands up to this size are indexed with one-deletion neighbourhoods.
SHORT = 36
#: Times a set of a short band is cut anew before it is indexed with its empty values: some 15% of the sets need each further time.
TURNS = 16
#: Elements per segment at the upper end of a longer band.
PER_SEGMENT = 3
#: Buckets up to this size give all their pairs at once.
CROWDED = 8
#: Index entries a task sorts at once, and text bytes that give about one entry.
PART_ENTRIES, BYTES_PER_ENTRY = 2_000_000, 8
#: Index entries a task gathers before it sends them.
FLUSH = 1_000_000
#: Members of a family of near copies that a task compares with as many others.
BLOCK, BLOCK_BYTES = 256, 2 << 20
#: Pairs of one pivot that are verified in one task.
PIVOT_PAIRS = 256


@functools.lru_cache(maxsize=None)
def bands(largest: int) -> np.ndarray:
    """Upper ends of the size bands, up to one beyond ``largest``."""
    ends = [4]
    while ends[-1] < largest or len(ends) < 2:
        ends.append(max(ends[-1] + 1, int(ends[-1] * GROWTH)))
    return np.array([*ends, max(ends[-1] + 1, int(ends[-1] * GROWTH))])


def differ(a, b):
    """Most elements in which similar sets of these sizes differ."""
    return (a + b) // 9


def segments(end: np.ndarray) -> np.ndarray:
    """Segments of a band by its upper end."""
    most = differ(end, end)
    return np.where(end <= SHORT, (most + 2) // 2, np.maximum(most + 1, -(-end // PER_SEGMENT)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def lowered_words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased; ``bytes`` methods touch ASCII alone."""
    return text.encode().lower().split()


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted 64-bit fingerprints of each text's distinct shingles."""
    numbers, starts, vocabulary = numbered(map(lowered_words, texts))
    code = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))[numbers]
    total = np.zeros(len(code), np.uint64)
    for k in range(WIDTH):
        if len(code) > k:
            total[: len(code) - k] = total[: len(code) - k] * np.uint64(0x5851F42D4C957F2D) + code[k:]
    total = _mix(total)
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= WIDTH:
            sets.append(np.unique(total[a : b - WIDTH + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b"\n".join([b"short", *(vocabulary[i] for i in numbers[a:b])]))], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def shingles(text: str) -> set[bytes]:
    """The shingles themselves. Words hold no space, so joining by spaces keeps them apart."""
    words = lowered_words(text)
    if len(words) < WIDTH:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}


def _entries(values: np.ndarray, sizes: np.ndarray, band: np.ndarray, ends: np.ndarray, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index entries of sets under one band each: (set number, signature), and how many more values each set may leave out.

    ``turn`` numbers the cuts into segments; sets of short bands with a segment of
    one element or none get the entries of the next cut as well.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end = ends[band]
    count = segments(end)
    start = np.concatenate([[0], np.cumsum(count)])
    place = _mix(values + np.uint64(turn)) if turn else values
    where = start[owner] + ((place >> np.uint64(20)) % count[owner].astype(np.uint64)).astype(np.int64)
    mixed = _mix(values)
    sums, filled = np.zeros(start[-1], np.uint64), np.bincount(where, minlength=start[-1])
    np.add.at(sums, where, mixed)
    seg_owner = np.repeat(np.arange(len(sizes)), count)
    seg = np.arange(start[-1]) - start[seg_owner]
    tag = _mix(seg.astype(np.uint64) + (np.uint64(turn) << np.uint64(32)) + (band[seg_owner].astype(np.uint64) << np.uint64(40)))
    short = end <= SHORT
    # the largest partner: 1.25 times the size, and in this band
    partner = np.minimum(end, sizes * 5 // 4)
    skip = np.where(short, 0, np.maximum(count - differ(sizes, partner) - 1, 0))
    # empty segments rank before all values, by number
    empty = (filled == 0) & ~short[seg_owner]
    order = np.cumsum(empty) - empty
    nth = order - order[start[:-1]][seg_owner]
    keep = ~(empty & (nth < skip[seg_owner]))
    skip = skip - np.minimum(skip, np.bincount(seg_owner[empty], minlength=len(sizes)))
    part = short[owner]
    thin = short[seg_owner] & (filled <= 1)
    if turn < TURNS:
        keep &= ~thin | (filled > 0)
        part &= filled[where] > 1
    deleted = sums[where[part]] - mixed[part] + tag[where[part]]
    who = np.concatenate([seg_owner[keep], owner[part]])
    signature = _mix(np.concatenate([(sums + tag)[keep], deleted]))
    again = np.unique(seg_owner[thin])
    if turn < TURNS and len(again):
        chosen = np.zeros(len(sizes), bool)
        chosen[again] = True
        more, further, _ = _entries(values[chosen[owner]], sizes[again], band[again], ends, turn + 1)
        who, signature = np.concatenate([who, again[more]]), np.concatenate([signature, further])
    return who, signature, skip


# A set in a blob: its node, and how many entries follow; the top bit marks the next band.
_UNIT = np.dtype([("node", "<u8"), ("n", "<u2")])
_NEXT = 1 << 15
# An entry that several sets share, and one that is left after the allocation.
_SHARED = np.dtype([("node", "<u8"), ("sig", "<u4"), ("freq", "<u4"), ("next", "u1")])
_KEPT = np.dtype([("node", "<u8"), ("sig", "<u4"), ("size", "<u4"), ("shared", "<u4")])


def _index(docs: DataFrame, parts: int) -> DataFrame:
    """One row per document, one per set by the part of its node (below 0), and blobs of index entries by part.

    A task emits a set and its entries once however many copies it holds, and deals
    its documents out over parts of their own, so that copies do not meet. A blob is
    the number of its sets, a _UNIT for each, then the low halves of their
    signatures; the high halves pick the part. Entries wait until FLUSH of them are
    there, so that a blob is large beside its table of sets.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        met = np.zeros(0, np.uint64)
        for part, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            sets = shingle_sets(texts)
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            last = np.cumsum(size)
            sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([_mix(flat), _mix(flat + np.uint64(7))]), 1, dtype=np.uint64)], 1)
            first, second = (_mix(x[last] - x[last - size] + size.astype(np.uint64)) for x in sums)
            del flat, sums
            ends = bands(int(size.max()))
            own, reach = np.searchsorted(ends, size), np.searchsorted(ends, size * 5 // 4)
            skips = np.zeros((2, len(sets)), np.int64)
            new = np.zeros(len(sets), bool)
            new[np.unique(first, return_index=True)[1]] = True
            # sets of fewer than 4 are similar to equal ones alone; sets of 4 to sets of 5 as well, which are in the next band
            for later in (0, 1):
                pick = np.flatnonzero((size >= 4) & (reach > own) if later else size > 4)
                if not len(pick):
                    continue
                who, signature, skips[later, pick] = _entries(np.concatenate([sets[i] for i in pick]), size[pick], own[pick] + later, ends)
                fresh = (new & ~np.isin(first, met))[pick[who]]
                to = ((signature >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                waiting.append((first[pick[who]][fresh], np.full(int(fresh.sum()), later, np.uint16), to[fresh], signature.astype(np.uint32)[fresh]))
            yield _rows(
                part=-1 - parts - ((first + np.arange(len(first), dtype=np.uint64)) % np.uint64(parts)).astype(np.int64),
                doc_id=part.column("doc_id"), text_key=part.column("text_key"), n=size, node=first.view(np.int64), second=second.view(np.int64),
            )
            new &= ~np.isin(first, met)
            yield _rows(
                part=-1 - (first[new] % np.uint64(parts)).astype(np.int64), n=size[new], node=first[new].view(np.int64),
                skip=skips[0][new], skip_next=skips[1][new],
            )
            met = np.union1d(met, first[new])
            if sum(len(w[0]) for w in waiting) >= FLUSH:
                yield _blobs(waiting, parts)
                waiting, met = [], np.zeros(0, np.uint64)
        if waiting:
            yield _blobs(waiting, parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part long, doc_id {kind}, text_key long, n long, node long, second long, skip long, skip_next long, blob binary"
    return docs.select("doc_id", "text_key", "text").mapInArrow(emit, schema)


def _blobs(waiting: list[tuple], parts: int) -> pa.RecordBatch:
    node, later, to, low = (np.concatenate(x) for x in zip(*waiting))
    order = np.lexsort((later, node, to))
    node, later, to, low = node[order], later[order], to[order], low[order]
    cuts = np.searchsorted(to, np.arange(parts + 1))
    blobs = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        start, length = _runs(node[a:b] * np.uint64(2) + later[a:b].astype(np.uint64))
        # a set with very many entries is several units
        pieces = np.maximum(-(-length // (_NEXT - 1)), 1)
        unit = np.zeros(int(pieces.sum()), _UNIT)
        unit["node"] = np.repeat(node[a:b][start], pieces)
        nth = np.arange(len(unit)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(np.repeat(length, pieces) - nth * (_NEXT - 1), _NEXT - 1)
        unit["n"] = size + np.repeat(later[a:b][start].astype(np.int64), pieces) * _NEXT
        blobs.append(np.uint32(len(unit)).tobytes() + unit.tobytes() + low[a:b].astype("<u4").tobytes())
    return _rows(part=np.arange(parts), blob=blobs)


_FIELDS = ("part", "doc_id", "text_key", "n", "node", "second", "skip", "skip_next", "blob")


def _rows(**columns) -> pa.RecordBatch:
    length = len(next(iter(columns.values())))
    arrays = []
    for name in _FIELDS:
        kind, value = pa.binary() if name == "blob" else pa.int64(), columns.get(name)
        arrays.append(pa.nulls(length, kind) if value is None else value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, list(_FIELDS))


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(sorted_)]]))


def _by_part(entry: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(to, kind="stable")
    entry, to = entry[order], to[order]
    for a, n in zip(*_runs(to)):
        yield int(to[a]), entry[a : a + n].tobytes()


def _shared(parts: int):
    """Group function: the entries of one part whose signature several sets hold, by the part of their node."""

    def group(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        if part < 0:  # documents and sets
            return rows
        give_back()
        units, lows = [], []
        for blob in rows["blob"].to_pylist():
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            units.append(np.frombuffer(blob, _UNIT, n, 4))
            lows.append(np.frombuffer(blob, "<u4", -1, 4 + n * _UNIT.itemsize))
        unit = np.concatenate(units)
        packed = np.concatenate(lows).astype(np.uint64)
        packed <<= np.uint64(32)
        packed |= np.repeat(np.arange(len(unit), dtype=np.uint32), unit["n"] % _NEXT)
        del units, lows
        packed.sort()
        _, length = _runs(packed >> np.uint64(32))
        packed = packed[np.repeat(length > 1, length)]
        entry = np.zeros(len(packed), _SHARED)
        owner = unit[(packed & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        entry["node"], entry["next"], entry["sig"] = owner["node"], owner["n"] >= _NEXT, packed >> np.uint64(32)
        del packed, owner
        # one entry per set and value: copies in several tasks and equal deletions fall together
        entry = entry[np.lexsort((entry["next"], entry["node"], entry["sig"]))]
        again = (entry["sig"][1:] == entry["sig"][:-1]) & (entry["node"][1:] == entry["node"][:-1])
        entry = entry[np.concatenate([[True], ~again])[: len(entry)]]
        _, length = _runs(entry["sig"])
        entry["freq"] = np.repeat(length, length)
        entry = entry[entry["freq"] > 1]
        found = list(_by_part(entry, -1 - (entry["node"] % np.uint64(parts)).astype(np.int64)))
        # second: the part the signatures belong to
        out = _rows(part=[p for p, _ in found], second=[part] * len(found), blob=[b for _, b in found])
        return pa.Table.from_batches([out])

    return group


def _allocated(rows: pa.Table) -> pa.Table:
    """Group function: of each set, the values that are left after the costliest it may leave out, by part."""
    give_back()
    node = np.asarray(rows["node"].combine_chunks().drop_null()).view(np.uint64)
    order = np.argsort(node)
    known = {name: np.asarray(rows[name].combine_chunks().drop_null())[order] for name in ("n", "skip", "skip_next")}
    node = node[order]
    blobs = [(p, np.frombuffer(b, _SHARED)) for p, b in zip(rows["second"].to_pylist(), rows["blob"].to_pylist()) if b is not None]
    if not blobs:
        return pa.Table.from_batches([_rows(part=[], blob=[])])
    entry = np.concatenate([b for _, b in blobs])
    part = np.concatenate([np.full(len(b), p, np.int64) for p, b in blobs])
    order = np.lexsort((entry["sig"], part, -entry["freq"].astype(np.int64), entry["next"], entry["node"]))
    entry, part = entry[order], part[order]
    same = (entry["node"][1:] == entry["node"][:-1]) & (entry["next"][1:] == entry["next"][:-1])
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    rank = np.arange(len(entry)) - np.repeat(start, np.diff(np.append(start, len(entry))))
    at = np.searchsorted(node, entry["node"])
    # a set that shares most of its values is near the middle of its copies
    runs = np.diff(np.append(start, len(entry)))
    shared = np.repeat(runs, runs)
    keep = rank >= np.where(entry["next"] == 1, known["skip_next"][at], known["skip"][at])
    kept = np.zeros(int(keep.sum()), _KEPT)
    kept["node"], kept["sig"], kept["size"] = entry["node"][keep], entry["sig"][keep], known["n"][at][keep]
    kept["shared"] = shared[keep]
    found = list(_by_part(kept, part[keep]))
    return pa.Table.from_batches([_rows(part=[p for p, _ in found], blob=[b for _, b in found])])


def _similar_sizes(a, b):
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """Group function: candidate pairs (a < b, number of buckets) and the members of crowded buckets."""
    give_back()
    entry = np.concatenate([np.frombuffer(b, _KEPT) for b in rows["blob"].to_pylist()])
    # the first set of a bucket is its pivot: the one that shares most
    entry = entry[np.lexsort((entry["node"], -entry["shared"].astype(np.int64), entry["sig"]))]
    start, length = _runs(entry["sig"])
    node, size = entry["node"].view(np.int64), entry["size"].astype(np.int64)
    left, right = [], []
    for k in range(1, CROWDED):  # all pairs at distance k of buckets that are not crowded
        for first in range(CROWDED - k):
            at = start[(length > first + k) & (length <= CROWDED)] + first
            left.append(at)
            right.append(at + k)
    crowd = length > CROWDED
    member = np.flatnonzero(np.repeat(crowd, length))
    pivot = np.repeat(start[crowd], length[crowd])
    left.append(pivot[member != pivot])
    right.append(member[member != pivot])
    a, b = np.concatenate(left), np.concatenate(right)
    fit = _similar_sizes(size[a], size[b]) & (node[a] != node[b])
    pair = np.stack([np.minimum(node[a[fit]], node[b[fit]]), np.maximum(node[a[fit]], node[b[fit]])], 1)
    pair, n = np.unique(pair, axis=0, return_counts=True) if len(pair) else (pair.reshape(0, 2), np.zeros(0, np.int64))
    zero = np.full(len(member), 0)
    return pa.table(
        {
            "a": pa.array(np.concatenate([pair[:, 0], node[member]]), pa.int64()),
            "b": pa.array(np.concatenate([pair[:, 1], (entry["sig"][member].astype(np.int64) << 31) + key[0].as_py()]), pa.int64()),
            "n": pa.array(np.concatenate([n, zero]), pa.int64()),
            "size": pa.array(np.concatenate([np.zeros(len(pair), np.int64), size[member]]), pa.int64()),
        }
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts are similar enough. ``texts``: node, text.

    The text of b travels to its pair, the text of a to each task that holds some
    of its pairs: a pivot with many pairs is spread over as many tasks as it needs.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_PAIRS).cast("int").alias("tasks"))
    spread = pairs.join(load, "a").withColumn("task", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int"))
    pivots = load.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select("a", "task")
    pivots = pivots.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    members = spread.select("a", "b", "task").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, set()
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"))):
                if a != pivot:
                    pivot, own = a, shingles(x.as_py())
                other = shingles(y.as_py())
                both = len(own & other)
                if 100 * both >= PERCENT * (len(own) + len(other) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        give_back()

    return members.join(pivots, ["a", "task"]).select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _across_components(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join components of crowded buckets. ``members``: node, c (component), lead (one node of a shared bucket).

    Nodes that share crowded buckets, directly or through others, are a family. A
    family is cut into blocks of about BLOCK nodes or BLOCK_BYTES of text and each pair of blocks is one task:
    it counts the common shingles of all its pairs by one product of incidence
    matrices, and returns only links that join two components, a forest of at most
    2 * BLOCK rows. No pair is written out, and no task holds a whole family.
    """
    # a node hangs on its smallest lead, its other leads on that one: the same families over fewer edges
    least = members.groupBy("node").agg(F.min("lead").alias("least"))
    leads = members.join(least, "node").where("lead <> least").select(F.col("lead").alias("a"), F.col("least").alias("b"))
    family = connected(least.select(F.col("node").alias("a"), F.col("least").alias("b")).unionAll(leads.distinct()))
    own = members.select("node", "c").distinct().join(family, "node")
    load = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)
    sized = own.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    blocks = sized.groupBy("component").agg(F.ceil(load).cast("int").alias("blocks"))
    placed = own.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.where("block <> other OR blocks = 1").select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "c")

    def compare(rows: pa.Table) -> pa.Table:
        node, label = np.asarray(rows["node"]), np.asarray(rows["c"])
        whole = [t.as_py() for t in rows["text"]]
        sets = shingle_sets(whole)
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        use = times[value] > 1
        column = np.cumsum(times > 1)[value] - 1
        owner, column = owner[use], column[use]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[a:b], column[a:b] - first] = 1
            both += part @ part.T
        total = size[:, None] + size[None, :]
        x, y = np.nonzero(np.triu(100 * both >= PERCENT * (total - both), 1))
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        # a forest: a link counts if it joins what is still apart, and if the words agree
        parent = {int(c): int(c) for c in label}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found, words = [], {}
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = root(int(label[i])), root(int(label[j]))
            if p != q:
                own_, other = (words.setdefault(k, shingles(whole[k])) for k in (i, j))
                common = len(own_ & other)
                if 100 * common >= PERCENT * (len(own_) + len(other) - common):
                    parent[q] = p
                    found.append((int(node[i]), int(node[j])))
        return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return spread.join(texts, "node").groupBy("component", "i", "j").applyInArrow(compare, "a long, b long")


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, node, root) for every row of ``docs`` (doc_id, text).

    Component_id is the smallest doc_id reachable over links of 0.8 or more,
    itself included; ``node`` names the set (equal sets are one node) and ``root``
    the component by its smallest node. A null or
    empty text has no shingles, no links and its own id; rows without doc_id take
    part and get the smallest id of their component, which is null where none has
    one. Repeated rows are each returned. No link between different sets is lost.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).withColumn("text_key", F.xxhash64("text"))
    volume = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(volume / (PART_ENTRIES * BYTES_PER_ENTRY)))
    index = _index(texts, parts)
    fields = index.schema
    shared = stage(index.groupBy("part").applyInArrow(_shared(parts), fields), "jaccard-shared")
    sets = shared.where("text_key IS NOT NULL").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "node", "second")
    # a set and its shared entries are in the same part
    kept = shared.where("text_key IS NULL").groupBy("part").applyInArrow(_allocated, fields)
    found = kept.groupBy("part").applyInArrow(_pairs, "a long, b long, n long, size long")
    found = stage(found, "jaccard-pairs")
    pairs = found.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    crowd = found.where("n = 0").select(F.col("a").alias("node"), F.col("b").alias("sig"), "size")

    # a text for every node that occurs in a pair
    classes = sets.where("n_shingles > 0").groupBy("node", "second").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"), F.min("doc_id").alias("smallest")
    )
    classes = stage(classes.select("node", "first.doc_id", "first.text_key", "smallest"), "jaccard-classes")
    wanted = found.select(F.col("a").alias("node")).unionAll(found.where("n > 0").select("b")).distinct()
    chosen = stage(classes.join(wanted, "node").select("node", "doc_id", "text_key"), "jaccard-chosen")
    chosen_small = small(chosen, chosen.count())
    same = texts.doc_id.eqNullSafe(chosen_small.doc_id) & (texts.text_key == chosen_small.text_key)
    held = texts.join(chosen_small, same).select("node", "text").dropDuplicates(["node"])
    held = stage(held, "jaccard-texts")

    # first the most promising partner of each node
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "n").unionAll(pairs.select(F.col("b").alias("x"), "a", "b", "n"))
    best = ends.groupBy("x").agg(F.max(F.struct("n", (-F.col("a")).alias("low"), "a", "b")).alias("best"))
    tried = stage(best.select("best.a", "best.b").distinct(), "jaccard-tried")
    edges = stage(_verified(tried, held), "jaccard-edges")
    known = connected(edges)

    # then every pair that would join two components
    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        own = known.select(F.col("node").alias(column), F.col("component").alias("label"))
        return df.join(own, column, "left").withColumn(name, F.coalesce("label", column)).drop("label")

    across = labelled(labelled(pairs.select("a", "b"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    rest = stage(across.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    more = _verified(rest, held)
    nearer = stage(edges.unionAll(more), "jaccard-edges")
    known = connected(nearer)
    members = labelled(crowd.select("node", "sig"), "node", "c")
    mixed = members.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("node").alias("lead")).where("lo <> hi")
    members = stage(members.join(mixed.select("sig", "lead"), "sig").select("node", "c", "lead").distinct(), "jaccard-crowd")
    more = stage(_across_components(members, held), "jaccard-edges")
    edges = nearer
    nodes = connected(edges.unionAll(more))

    placed = stage(classes.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-placed")
    smallest = placed.groupBy("component").agg(F.min("smallest").alias("component_id"))
    large = stage(frequent(placed, "component", placed.count()), "jaccard-large")
    # equal fingerprints of different sets stay apart in ``second``; they share a component only by links
    by_node = lookup(placed.select("node", "component").distinct(), smallest, "component", large).select("node", "component_id", F.col("component").alias("root"))
    # a text that many rows share is one node
    joined = lookup(sets, by_node, "node", stage(frequent(sets, "node", sets.count()), "jaccard-often"), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), "node", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id.

    Rows without words are linked with nothing and stay. All columns are kept.
    """
    sets = stage(link(docs.select("doc_id", "text")), "jaccard-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    kept = sets.where("n_shingles > 0").groupBy("root").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key"))
    kept = stage(kept, "jaccard-kept")
    # a kept id and text that several rows carry, and ids of which each row stays
    again = sets.where("n_shingles > 0").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    wordless = ~text_or_empty("text").rlike(WORD)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64(text_or_empty("text")).alias("text_key"), wordless.alias("wordless"))
    few = small(kept, kept.count())
    found = rows.where(~F.col("wordless")).join(few, rows.doc_id.eqNullSafe(few.id) & (rows.text_key == few.key), "left_semi")
    if again:
        found = found.dropDuplicates(["doc_id", "text_key"])
    return found.unionAll(rows.where("wordless")).select("row.*")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under 5-word shingles and a similarity of 0.8."""
    return link(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")
