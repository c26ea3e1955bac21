"""Exact top-k inner products from an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.common import table

K = 10
#: Rows of a corpus block and queries of a query block: what one task holds.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 256
#: Quantised impacts of a dimension.
LEVELS = 256
#: Impact thresholds, as shares of a query's largest impact, at which a proof is tried.
ROUNDS = (0.03, 0.0)
#: Classes of a weight against the query's largest, each half of the one before.
CLASSES = 8
#: Indexed components are whole numbers below this, so that sums of products fit 64 bits; vectors with larger ones are scored apart.
COMPONENT_LIMIT = 1 << 25


class ImpactIndex:
    """Impacts of one block. Every dimension is indexed for both signs of a query's weight.

    For a positive weight the impact of a row is its component less the smallest
    of the block, for a negative weight the largest less its component; impacts
    are never negative. They are quantised to LEVELS levels; the rows of a level
    of a dimension are one posting segment.
    """

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.low, self.high = rows.min(0), rows.max(0)
        impact = np.concatenate([rows - self.low, self.high - rows], 1)
        self.step = np.maximum(impact.max(0) // LEVELS + 1, 1)
        self.level = (impact // self.step).astype(np.int16)

    def _bounds(self, weight: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and most each query (rows of ``weight``) can score, with all segments processed whose impact reaches a threshold.

        Score at a time: a segment's impact is weight times quantised impact. The
        threshold is ``share`` of the query's largest impact; dimensions whose
        weights are of one class have one level from which their segments are
        processed, so a class is one product of matrices for all queries. A row met
        in a segment counts with its level, a row not met yet with 0 and with the
        most it can have below the segments processed.
        """
        unit = weight * self.step
        ratio = unit / np.maximum(unit.max(1, keepdims=True), 1)
        kind = np.clip(np.floor(-np.log2(np.maximum(ratio, 1e-9))), 0, CLASSES - 1).astype(np.int64)
        least = np.zeros((len(weight), len(self.rows)))
        most = np.zeros_like(least)
        for c in range(CLASSES):
            own = np.where((kind == c) & (weight > 0), weight, 0).astype(np.float64)
            dims = np.flatnonzero(own.any(0))
            if not len(dims):
                continue
            # the last class reaches down to weights of nearly nothing: its segments come last
            floor = 0 if not share else min(math.ceil(share * (LEVELS - 1) * 2**c), LEVELS)
            level, step = self.level[:, dims], self.step[dims]
            met = level >= floor
            known = np.where(met, level * step, 0).astype(np.float64)
            limit = np.where(met, known + (step - 1), floor * step - 1)
            least += own[:, dims] @ known.T
            most += own[:, dims] @ limit.T
        return least, most

    def top(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows that may be among its k best, with exact scores. ``own``: rows that are not candidates."""
        weight = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], 1)
        found: list[np.ndarray] = [np.setdiff1d(np.arange(len(self.rows)), x) for x in own]
        open_ = np.array([i for i, x in enumerate(found) if len(x) > k], np.int64)
        for share in ROUNDS:
            if not len(open_):
                break
            least, most = self._bounds(weight[open_], share)
            # rounding of the sums must not break the proof
            slack = np.maximum(most.max(1), 1) * 1e-12
            going = []
            for i, low, high, error in zip(open_.tolist(), least, most, slack):
                candidates = found[i]
                sure = np.partition(low[candidates], len(candidates) - k)[len(candidates) - k]
                # all that are left out are proven worse than k others
                found[i] = candidates[high[candidates] >= sure - error]
                if len(found[i]) > max(k, len(self.rows) // 16):
                    going.append(i)
            open_ = np.array(going, np.int64)
        return [(rows, self.rows[rows] @ query) for rows, query in zip(found, queries)]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; missing components are 0."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
    out = np.zeros((len(ends), width), np.int64)
    row = np.repeat(np.arange(len(ends)), ends)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, wide): components as floor(1024 * x). Vectors that are null, hold null or non-finite components, or have no id, drop out.

    A vector with a component that reaches COMPONENT_LIMIT has no ``v`` but its components as they are in ``wide``.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024))
    size = lambda c: F.abs(c.cast("double"))
    sound = F.forall("embedding", lambda c: F.coalesce(size(c) < math.inf, F.lit(False)) & ~F.isnan(c))
    huge = F.exists("embedding", lambda c: size(c) * 1024 >= COMPONENT_LIMIT)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(~huge, x.cast("array<long>")).alias("v"),
        F.when(huge, F.col("embedding").cast("array<double>")).alias("wide"),
    )


def _exact(x: float) -> int:
    """floor(1024 * x) of any size."""
    n, d = x.as_integer_ratio()
    return n * 1024 // d


class Vectors:
    """Vectors of one table in a task: those below COMPONENT_LIMIT as a matrix, the others as Python integers."""

    def __init__(self, rows: pa.Table, width: int):
        wide = np.asarray(rows["wide"].is_valid())
        self.narrow, self.wide = np.flatnonzero(~wide), np.flatnonzero(wide)
        self.matrix = _matrix(rows["v"].take(pa.array(self.narrow)), width)
        components = rows["wide"].take(pa.array(self.wide)).to_pylist()
        self.integers = [[_exact(x) for x in row] + [0] * (width - len(row)) for row in components]
        # whole numbers, exact as doubles up to overflow
        self.rounded = np.zeros((len(components), width))
        for i, row in enumerate(components):
            self.rounded[i, : len(row)] = [math.floor(x * 1024) if abs(x) < 1e300 else x * 1024 for x in row]


def _best_exact(integers, rounded: np.ndarray, query: list[int], near: np.ndarray, k: int, candidates: np.ndarray) -> tuple[list[int], list[int]]:
    """Of ``candidates`` (row numbers) those that may be among the k best, and their exact scores.

    ``rounded`` and ``near`` are the rows and the query as doubles. Rows that doubles
    prove worse than k others, with the most that rounding can do, are left out.
    """
    if len(candidates) > k:
        with np.errstate(all="ignore"):
            rows = rounded[candidates]
            score, error = rows @ near, (np.abs(rows) @ np.abs(near)) * ((len(near) + 2) * 2.0**-52)
            if np.isfinite(score).all() and np.isfinite(error).all():
                sure = np.partition(score - error, len(candidates) - k)[len(candidates) - k]
                candidates = candidates[score + error >= sure]
    return candidates.tolist(), [sum(map(mul, integers[i], query)) for i in candidates.tolist()]


def _digits(score: int) -> tuple[int | None, int, bytes | None]:
    """(score, size, digits): scores sort by size, digits and score; only one beyond 64 bits has a size and digits, and it has no score."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    size = (abs(score).bit_length() + 7) // 8
    return (None, size, score.to_bytes(size, "big")) if score > 0 else (None, -size, ((1 << 8 * size) - 1 + score).to_bytes(size, "big"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Both tables are (vec_id, v array<long>), and ``wide`` as ``whole_numbers`` gives it if they have it. Each pair of a query block and a corpus
    block is one task, which builds the index of the corpus block and answers its
    queries from it; the k best of every block are merged by rank. Ties go to the
    smaller vec_id. Rows that carry a query's own id are no candidates for it. A
    query id that occurs in several rows is answered from all of them: its ranks are
    over the scores of all its rows, so that a candidate can be listed once for each.
    A candidate id that occurs twice can be listed twice as well. Vectors of
    unequal length are padded with zeros; vectors without components score 0. Wide
    vectors are ranked by exact scores like all others; a score that does not fit 64
    bits is ranked but returned as null.
    """
    corpus, queries = (x if "wide" in x.columns else x.withColumn("wide", F.lit(None).cast("array<double>")) for x in (corpus, queries))
    queries = queries.groupBy("vec_id", "v", "wide").agg(F.count(F.lit(1)).alias("copies"))
    corpus, queries = stage(corpus, "topk-corpus"), stage(queries, "topk-queries")
    longest = F.coalesce(F.max(F.greatest(F.size("v"), F.size("wide"))), F.lit(0))
    size = corpus.agg(F.count(F.lit(1)).alias("n"), longest.alias("w")).first()
    asked = queries.agg(F.count(F.lit(1)).alias("n"), longest.alias("w")).first()
    blocks, turns, width = math.ceil(size["n"] / block_rows) or 1, math.ceil(asked["n"] / block_queries) or 1, max(size["w"], asked["w"])
    left = corpus.select(
        F.pmod(F.xxhash64("vec_id", "v", "wide"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "vec_id", "v", "wide",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", "v", "wide"), F.lit(turns)).cast("int").alias("turn"), "vec_id", "v", "wide", F.least("copies", F.lit(k)).alias("copies"),
    )

    def answer(rows: pa.Table, asked_: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], [], [], []]
        if rows.num_rows and asked_.num_rows:
            ids, query_ids = np.asarray(rows["vec_id"]), np.asarray(asked_["vec_id"])
            has, asks, copies = Vectors(rows, width), Vectors(asked_, width), np.asarray(asked_["copies"])
            own = [np.flatnonzero(ids[has.narrow] == q) for q in query_ids[asks.narrow]]
            indexed = len(has.narrow) and len(asks.narrow)
            near = ImpactIndex(has.matrix).top(asks.matrix, k, own) if indexed else [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(own)
            matrix, doubles = has.matrix.tolist() if len(asks.wide) else [], has.matrix.astype(np.float64)

            def wide_rows(query_id: int, query: list[int], rounded: np.ndarray) -> list[tuple[int, int]]:
                row, score = _best_exact(has.integers, has.rounded, query, rounded, k, np.flatnonzero(ids[has.wide] != query_id))
                return list(zip(score, ids[has.wide[row]].tolist())) if row else []

            def put(query_id: int, n: int, scored: list[tuple[int, int]]) -> None:
                for score, vec_id in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]:
                    for column, value in zip(found, (query_id, vec_id, *_digits(score), n)):
                        column.append(value)

            for query_id, n, query, (row, score) in zip(query_ids[asks.narrow].tolist(), copies[asks.narrow].tolist(), asks.matrix, near):
                id_ = ids[has.narrow[row]]
                best = np.lexsort((id_, -score))[:k]
                put(query_id, n, [*zip(score[best].tolist(), id_[best].tolist()), *wide_rows(query_id, query.tolist(), query.astype(np.float64))])
            for query_id, n, query, rounded in zip(query_ids[asks.wide].tolist(), copies[asks.wide].tolist(), asks.integers, asks.rounded):
                row, score = _best_exact(matrix, doubles, query, rounded, k, np.flatnonzero(ids[has.narrow] != query_id))
                put(query_id, n, [*zip(score, ids[has.narrow[np.array(row, np.int64)]].tolist()), *wide_rows(query_id, query, rounded)])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(found, kinds)], ["query_id", "vec_id", "score", "size", "digits", "copies"])

    near = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(answer, "query_id long, vec_id long, score long, size int, digits binary, copies long")
    # equal rows of a query have equal scores
    near = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("digits"), F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every vector whose id is divisible by 100, among all vectors."""
    vectors = whole_numbers(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)
