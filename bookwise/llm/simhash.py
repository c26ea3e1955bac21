"""SimHash near-duplicates: fingerprints over word shingles, linked by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.batches import give_back, slices, words_of
from bookwise.llm.common import small, table, text_or_empty
from bookwise.llm.components import connected

BITS = 64
SHINGLE_WORDS = 3
HASH_SEED = 42
#: Fingerprints that differ in at most so many bits are linked.
WITHIN = 3
#: What a row of the index costs, in comparisons of two fingerprints.
ROW_COST = 1000
#: Bits of the pieces whose histograms the estimates are made from.
PIECE = 8
#: Rows of a bucket that one group compares; larger buckets are cut into blocks that meet in pairs.
CROWDED = 4096
#: Buckets of up to so many rows are compared side by side.
SHORT = 16
#: Fingerprints that more than one row in so many carries are joined apart.
HOT_SHARE = 1000

_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[str]) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if it is 1 in over half of the hashes of its shingles."""
    found: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        line = b" ".join(words).lower()
        if len(words) <= SHINGLE_WORDS:
            found.append(xxhash.xxh64_intdigest(line, HASH_SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - SHINGLE_WORDS] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        found += [digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())]
        sizes[i] = len(words) - SHINGLE_WORDS + 1
    return majorities(np.array(found, np.uint64), sizes)


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bitwise majorities of runs of ``sizes`` hashes; 0 for an empty run.

    Eight lanes of a byte each count eight bits at once, over at most 255 hashes.
    """
    prints = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return prints
    blocks = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    starts = np.repeat(begin - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    counts = np.empty((len(starts), 8, 8), np.int64)  # block, byte of the hash, bit of the byte
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, starts)
        counts[:, :, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(counts.reshape(len(starts), BITS), first, axis=0)
    ones = 2 * sums > sizes[full][:, None]
    prints[full] = (ones.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return prints


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, print) for every row of ``docs`` (doc_id, text); ``print`` is the fingerprint as a signed 64-bit number."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(texts).view(np.int64))], ["doc_id", "print"])

    read = docs.select("doc_id", text_or_empty("text").alias("text"))
    return read.mapInArrow(prints, read.select("doc_id").schema.add("print", "long"))


def ball(width: int, radius: int) -> int:
    """Values of ``width`` bits within ``radius`` of one of them; none for a negative radius."""
    return sum(comb(width, e) for e in range(radius + 1))


def widths(parts: int) -> list[int]:
    return [BITS // parts + (i < BITS % parts) for i in range(parts)]


def partition_count(n: int, within: int = WITHIN) -> int:
    """Number of partitions with the least expected work for ``n`` evenly spread fingerprints."""

    def work(parts: int) -> float:
        left, cost = within - parts + 1, 0.0
        for i, width in enumerate(widths(parts)):
            balls = ball(width, left // parts + (i < left % parts))
            cost += balls * (ROW_COST + n / 2**width)
        return cost

    return min(range(1, within + 2), key=work)


def correlated_groups(ones: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups: each grows by the bit most correlated with those it has.

    ``ones[i, j]`` counts fingerprints in which bits i and j are both 1.
    """
    p = np.diag(ones) / max(n, 1)
    spread = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = np.abs((ones / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    strength = np.round(np.nan_to_num(strength, posinf=0, neginf=0), 9)
    np.fill_diagonal(strength, 0)
    left, groups = list(range(BITS)), []
    for width in widths(parts):
        among = strength[np.ix_(left, left)].sum(1)
        group = [left[int(np.argmax(among))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(strength[np.ix_(rest, group)].sum(1)))])
        groups.append(group)
        left = [b for b in left if b not in group]
    return groups


def gathered(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint as one number."""
    out = np.zeros(len(prints), np.uint64)
    for at, bit in enumerate(bits):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
    return out


def pieces(groups: list[list[int]]) -> list[list[list[int]]]:
    return [[g[i : i + PIECE] for i in range(0, len(g), PIECE)] for g in groups]


def near_shares(histogram: np.ndarray, within: int) -> np.ndarray:
    """For each value of a piece the share of fingerprints at exactly 0, 1, ... ``within`` bits from it."""
    values = np.arange(len(histogram), dtype=np.uint64)
    apart = np.bitwise_count(values[:, None] ^ values)
    share = histogram / max(1, histogram.sum())
    return np.stack([(apart == e) @ share for e in range(within + 1)], 1)


def allocate(prints: np.ndarray, groups: list[list[int]], shares: list[list[np.ndarray]], n: int, within: int) -> np.ndarray:
    """A threshold for every fingerprint and partition, -1 for partitions that need no probe.

    The thresholds of a fingerprint add up to ``within`` - partitions + 1: of two
    fingerprints within that distance some partition differs by no more than its
    threshold. Of all such allocations the one with the least estimated cost is
    found by dynamic programming over the partitions. The estimate takes the pieces
    of a partition as independent; it decides the cost alone, never the result.
    """
    parts, most = len(groups), within
    sums = {0: np.zeros(len(prints))}  # threshold sum so far (shifted by the partitions so far) -> cost
    choices: list[dict[int, np.ndarray]] = []
    for group, cut, tables in zip(groups, pieces(groups), shares):
        exact = np.zeros((len(prints), most + 1))
        exact[:, 0] = 1
        for bits, near in zip(cut, tables):
            own = near[gathered(prints, bits).astype(np.int64)]
            exact = np.stack([sum(exact[:, k] * own[:, e - k] for k in range(e + 1)) for e in range(most + 1)], 1)
        found = n * np.cumsum(exact, 1)
        cost = {-1: np.full(len(prints), float(ROW_COST))}
        cost |= {t: ROW_COST * ball(len(group), t) + found[:, t] for t in range(most + 1)}
        grown: dict[int, np.ndarray] = {}
        chosen: dict[int, np.ndarray] = {}
        for had, before in sums.items():
            for t in range(-1, most + 1):
                to, value = had + t + 1, before + cost[t]
                if to not in grown:
                    grown[to], chosen[to] = value, np.full(len(prints), t, np.int8)
                else:
                    better = value < grown[to]
                    grown[to] = np.where(better, value, grown[to])
                    chosen[to] = np.where(better, t, chosen[to]).astype(np.int8)
        sums = grown
        choices.append(chosen)
    at = np.full(len(prints), within + 1, np.int64)
    thresholds = np.empty((len(prints), parts), np.int8)
    for i in range(parts - 1, -1, -1):
        for total, chosen in choices[i].items():
            here = at == total
            thresholds[here, i] = chosen[here]
        at = at - thresholds[:, i] - 1
    return thresholds


def _columns(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[np.ndarray]:
    for batch in batches:
        values = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(values), rows):
            yield values[i : i + rows]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ones = np.zeros((BITS, BITS), np.int64)
    for prints in _columns(batches):
        bits = ((prints[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
        ones += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(ones.ravel())], ["cell", "n"])


def _histograms(cut: list[list[list[int]]]) -> Callable:
    flat = [bits for group in cut for bits in group]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(flat), 1 << PIECE), np.int64)
        for prints in _columns(batches):
            for i, bits in enumerate(flat):
                held[i] += np.bincount(gathered(prints, bits).astype(np.int64), minlength=1 << PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(held.size, dtype=np.int32)), pa.array(held.ravel())], ["cell", "n"])

    return count


def _table(prints: DataFrame, count: Callable, shape: tuple[int, int]) -> np.ndarray:
    """A table of counts over all fingerprints; its size is fixed."""
    summed = prints.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(shape, np.int64)
    for row in summed.collect():
        out.flat[row.cell] = row.n
    return out


def _entries(groups: list[list[int]], shares: list[list[np.ndarray]], n: int, within: int) -> Callable:
    """Index rows (part, value, print, kind): kind 0 is found, 1 is found and probes, 2 probes alone."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints in _columns(batches, 1 << 14):
            thresholds = allocate(prints, groups, shares, n, within)
            for i, bits in enumerate(groups):
                own, radius = gathered(prints, bits), thresholds[:, i]
                yield _rows(i, own, prints, np.minimum(radius, 0) + 1)
                for t in range(1, within + 1):
                    reach = radius >= t
                    if reach.any():
                        for flips in combinations(range(len(bits)), t):
                            mask = np.uint64(sum(1 << f for f in flips))
                            yield _rows(i, own[reach] ^ mask, prints[reach], np.full(int(reach.sum()), 2))
        give_back()

    return entries


def _rows(part: int, value: np.ndarray, prints: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(value), part, np.int32), value.view(np.int64), prints.view(np.int64), kind.astype(np.int8)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "value", "print", "kind"])


def _linked(a: np.ndarray, ka: np.ndarray, b: np.ndarray, kb: np.ndarray, within: int) -> np.ndarray:
    met = ((ka >= 1) & (kb <= 1)) | ((ka <= 1) & (kb >= 1))
    return met & (np.bitwise_count(a ^ b) <= within) & (a != b)


def bucket_edges(bucket: np.ndarray, prints: np.ndarray, kind: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked inside each bucket; rows are sorted by bucket.

    Of a long bucket a spanning forest is returned, of a short one every link.
    """
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [len(bucket)]]))
    left, right = [], []
    few = np.repeat((sizes > 1) & (sizes <= SHORT), sizes)
    b, p, k = bucket[few], prints[few], kind[few]
    for d in range(1, SHORT):
        if len(b) <= d:
            break
        same = np.flatnonzero(b[d:] == b[:-d])
        if not len(same):
            break
        hit = same[_linked(p[same], k[same], p[same + d], k[same + d], within)]
        left.append(p[hit])
        right.append(p[hit + d])
    for start, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
        p, k = prints[start : start + size], kind[start : start + size]
        while len(p):
            todo, p, k = [(p[0], k[0])], p[1:], k[1:]
            while todo and len(p):
                one, own = todo.pop()
                hit = _linked(p, k, one, own, within)
                if hit.any():
                    left.append(np.full(int(hit.sum()), one))
                    right.append(p[hit])
                    todo += zip(p[hit], k[hit])
                    p, k = p[~hit], k[~hit]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _compare(within: int) -> Callable:
    """Rows arrive sorted by bucket; a bucket that a batch ends in waits for the next."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("bucket", "print", "kind")]
            columns[1] = columns[1].view(np.uint64)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            held = [c[cut:].copy() for c in columns]
            if cut:
                yield _edges(*(c[:cut] for c in columns))
        if held is not None and len(held[0]):
            yield _edges(*held)
        give_back()

    def _edges(bucket: np.ndarray, prints: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_edges(bucket, prints, kind, within)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return compare


def near_edges(prints: DataFrame, within: int = WITHIN) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints of column ``print`` within ``within`` bits of each other."""
    n = prints.count()
    parts = partition_count(n, within)
    groups = correlated_groups(_table(prints, _together, (BITS, BITS)), n, parts)
    cut = pieces(groups)
    counts = iter(_table(prints, _histograms(cut), (sum(map(len, cut)), 1 << PIECE)))
    shares = [[near_shares(next(counts)[: 1 << len(bits)], within) for bits in group] for group in cut]
    entries = stage(prints.mapInArrow(_entries(groups, shares, n, within), "part int, value long, print long, kind byte"), "simhash-entries")

    crowded = entries.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED)
    crowded = stage(crowded.select("part", "value", F.ceil(F.col("n") / CROWDED).cast("int").alias("blocks")), "simhash-crowded")
    placed = entries.join(small(crowded, crowded.count()), ["part", "value"], "left")
    block = F.pmod(F.xxhash64("print"), "blocks").cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("part", "value", F.least(j, block), F.greatest(j, block)))
    own = F.array(F.xxhash64("part", "value"))
    placed = placed.select(F.explode(F.when(F.col("blocks").isNull(), own).otherwise(meets)).alias("bucket"), "print", "kind")
    sorted_ = placed.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(_compare(within), "a long, b long")


def link(docs: DataFrame, within: int = WITHIN) -> DataFrame:
    """(doc_id, print, component_id) for every row of ``docs`` (doc_id, text).

    ``print`` is the fingerprint (signed 64 bits) over 3-word shingles, repeats
    included, lower-cased in A-Z; texts of one or two words are one shingle, null,
    empty and blank texts have the fingerprint 0, which links like any other.
    ``component_id`` is the smallest doc_id reachable over fingerprints that differ
    in at most ``within`` bits; rows without doc_id take part and get the smallest id of
    their component, null if none has one. Repeated rows are each returned, other
    columns are never read, an empty table gives no rows. No link is lost.
    """
    rows = stage(fingerprinted(docs), "simhash-prints")
    nodes = stage(rows.groupBy("print").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    labels = connected(near_edges(nodes.select("print"), within)).select(F.col("node").alias("print"), "component")
    joined = stage(nodes.join(labels, "print", "left").withColumn("component", F.coalesce("component", "print")), "simhash-joined")
    first = joined.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    first = first.where("prints > 1").select("component", "component_id")
    named = joined.join(first, "component", "left").select("print", "rows", F.coalesce("component_id", "smallest").alias("component_id"))
    named = stage(named, "simhash-named")
    # fewer than HOT_SHARE fingerprints can be hot
    total = named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = named.where(F.col("rows") * HOT_SHARE > total).drop("rows")
    held = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "print", "left")
    cold = held.where("hot IS NULL").select("doc_id", "print").join(named.drop("rows"), "print")
    return held.where("hot").select("doc_id", "print", "component_id").unionAll(cold.select("doc_id", "print", "component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    linked = link(table(spark, sf_dir, "documents", "doc_id", "text"))
    return linked.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
