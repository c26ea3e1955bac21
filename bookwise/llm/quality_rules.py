"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise.llm.batches import SHORT_SLICE_BYTES, numbered, per_text, slices, words_of
from bookwise.llm.common import small, table

#: Buckets of the two multinomials: words and pairs of neighbouring words share them.
BUCKETS = 1 << 16
#: Added to both expected counts of a bucket; keeps buckets that hold next to nothing near a ratio of 1.
SMOOTHING = 4.0
#: Log ratios are rounded to multiples of 1 / SCALE, so that sums are exact and do not depend on order.
SCALE = 1 << 20
#: Least mean log ratio per n-gram of a kept document (natural logarithm).
THRESHOLD = -0.12
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def _code(word: bytes) -> int:
    return int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big")


def ngram_buckets(texts: list[str], n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and of all word pairs, end to end, and the starts of each text in both."""
    return _buckets(*numbered(map(words_of, texts)), n_buckets)


def _buckets(numbers: np.ndarray, starts: np.ndarray, vocabulary: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code = np.fromiter(map(_code, vocabulary), np.int64, len(vocabulary))[numbers]
    inside = np.ones(max(0, len(code) - 1), bool)
    cuts = starts[1:-1]
    inside[cuts[(cuts > 0) & (cuts < len(code))] - 1] = False
    pairs = code[:-1] * 1_000_003
    pairs += code[1:]
    pairs %= n_buckets
    pairs = pairs[inside]
    lengths = np.maximum(np.diff(starts) - 1, 0)
    code %= n_buckets
    return code, starts, pairs, np.concatenate([[0], np.cumsum(lengths)])


def ngram_counts(docs: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all texts of ``docs`` by bucket. A task sends one row per bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for _, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            words, _, pairs, _ = ngram_buckets(texts, n_buckets)
            total += np.bincount(words, minlength=n_buckets) + np.bincount(pairs, minlength=n_buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    return docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(trusted: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Rounded log of (trusted / raw) per bucket, both smoothed at the size of the trusted target; zeros without a target."""
    if not trusted.sum() or not raw.sum():
        return np.zeros(len(raw), np.int64)
    expected = raw * (trusted.sum() / raw.sum())
    return np.round(np.log((trusted + smoothing) / (expected + smoothing)) * SCALE).astype(np.int64)


def fit(docs: DataFrame, trusted: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Bucket weights from all texts of both tables; the driver holds n_buckets counts of each."""
    counts = np.zeros((2, n_buckets), np.int64)
    for side, part in enumerate((trusted, docs)):
        for bucket, n in ngram_counts(part, n_buckets).collect():
            counts[side, bucket] = n
    return log_ratios(*counts)


def _repeated(numbers: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice."""
    if len(numbers) < 4:
        return 0
    if numbers.max() >= 1 << 21:  # three numbers must fit 63 bits
        numbers = np.unique(numbers, return_inverse=True)[1]
    if numbers.max() >= 1 << 21:
        pairs = np.unique(numbers[:-1] << 31 | numbers[1:], return_inverse=True)[1]
        windows = pairs[:-1] << 31 | numbers[2:]
    else:
        windows = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : len(hit) + k] |= hit
    return int(covered.sum())


def _base(texts: list[str], numbers: np.ndarray, starts: np.ndarray) -> dict[str, list[int]]:
    return {
        "n_words": np.diff(starts).tolist(),
        "word_chars": [len(t) - sum(map(t.count, SPACES)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in ([y for y in t.split("\n") if y.strip(SPACES)] for t in texts)],
        "n_repeat_words": [_repeated(numbers[a:b]) for a, b in zip(starts[:-1], starts[1:])],
    }


def _judged(texts: list[str], weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Base figures, summed weights, number of n-grams, and who fails the base rules."""
    numbers, starts, vocabulary = numbered(map(words_of, texts))
    base = _base(texts, numbers, starts)
    words, _, pairs, pair_starts = _buckets(numbers, starts, vocabulary, len(weight))
    total = per_text(weight[words], starts) + per_text(weight[pairs], pair_starts)
    n, again = np.array(base["n_words"]), np.array(base["n_repeat_words"])
    failed = (n < MIN_WORDS) | (100 * again > MAX_REPEAT_PERCENT * n)
    return base, total, np.diff(starts) + np.diff(pair_starts), failed


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without text, with the base figures, ``llr``, ``base_failed`` and ``kept``.

    ``llr`` is the mean weight of the text's n-grams (0 without any). A document
    is kept if it passes the base rules and llr >= threshold, decided in integers.
    A null text has no words and fails; equal rows get equal results.
    """
    others = [c for c in docs.columns if c != "text"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if clash := {*names, "llr", "base_failed", "kept"} & set(others):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    schema = docs.select(*others).schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("llr", "double").add("base_failed", "boolean").add("kept", "boolean")
    shared, limit = docs.sparkSession.sparkContext.broadcast(weights), round(threshold * SCALE)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            base, total, grams, failed = _judged(texts, shared.value)
            out = pa.Table.from_batches([part]).select(others)
            for name in names:
                out = out.append_column(name, pa.array(base[name], pa.int64()))
            out = out.append_column("llr", pa.array(total / np.maximum(grams, 1) / SCALE))
            out = out.append_column("base_failed", pa.array(failed))
            yield from out.append_column("kept", pa.array(~failed & (total >= limit * grams))).to_batches()

    return docs.mapInArrow(rate, schema)


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, with all their columns."""
    shared, limit = docs.sparkSession.sparkContext.broadcast(weights), round(threshold * SCALE)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            _, total, grams, failed = _judged(texts, shared.value)
            yield part.filter(pa.array(~failed & (total >= limit * grams)))

    return docs.mapInArrow(pick, docs.schema)


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of documents that a label calls good; a document counts once however often it is labelled."""
    good = labels.where(F.col("quality") == 1).select("doc_id").distinct()
    return docs.select("doc_id", "text").join(small(good, good.count()), "doc_id", "left_semi")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document; the trusted target are all documents labelled good."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return score(docs, fit(docs, trusted_documents(docs, labels)))
