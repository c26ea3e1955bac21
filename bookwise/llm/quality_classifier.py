"""Quality classifier: similarity-weighted votes of the nearest labelled latent-semantic vectors."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bookwise.llm.batches import SHORT_SLICE_BYTES, slices, words_of
from bookwise.llm.common import table

#: Hashed byte trigrams, and one further term: a word that repeats the word before it.
TRIGRAMS = 4096
TERMS = TRIGRAMS + 1
#: Weight of the repetition term, in place of an inverse document frequency.
REPEAT_WEIGHT = 4.0
#: Dimensions of the latent space.
RANK = 48
#: Most labelled documents fitted on and voted by: the LABELLED with the smallest hash of their id.
LABELLED = 2048
NEIGHBOURS = 15
#: Documents multiplied with the labelled vectors at once.
BLOCK = 256
#: Steps to 1 a cosine is rounded to before neighbours are compared.
GRID = 1 << 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of each text's terms: one row of TERMS per text."""
    rows = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(rows, texts):
        raw = np.frombuffer(text.encode(), np.uint8)
        # a long text is counted in runs that overlap by the two bytes a trigram reaches back
        for at in range(0, len(raw) - 2, 1 << 20):
            b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
            code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2_654_435_761) >> np.uint32(20)
            row[:TRIGRAMS] += np.bincount(code, minlength=TRIGRAMS)
        words = words_of(text)
        row[TRIGRAMS] = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    return rows


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of sqrt(term frequency) * idf; a text without terms stays zero."""
    total = np.maximum(counts[:, :TRIGRAMS].sum(1, keepdims=True), 1)
    rows = np.array(counts)
    rows[:, :TRIGRAMS] /= total
    np.sqrt(rows, out=rows)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and their number; a task sends TERMS counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(TERMS + 1, np.int64)
        for _, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            for at in range(0, len(texts), BLOCK):
                block = term_counts(texts[at : at + BLOCK])
                found[:TERMS] += (block > 0).sum(0)
                found[TERMS] += len(block)
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(found[met])], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for term, n in docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out[:TERMS], int(out[TERMS])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, quality, text) of at most ``most`` labelled documents outside the held-out third.

    A document with several labels takes part with their mean, rounded; labels
    other than 0 and 1 and labels without a document do not take part. Of several
    rows of an id the text with the smallest hash takes part, then the one that sorts
    first, so the sample does not depend on how the table is laid out.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("quality"))
    first = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("one")).join(F.broadcast(first), "doc_id")
    return found.groupBy("doc_id", "quality").agg(F.min("one").alias("one")).select("doc_id", "quality", "one.text")


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """The model: idf over all documents, a projection, and the labelled vectors with their labels.

    The driver holds LABELLED rows of TERMS counts, whatever the size of the corpus.
    """
    found, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    idf[TRIGRAMS] = REPEAT_WEIGHT

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            rows = tf_idf(term_counts(texts), idf)
            met = [np.flatnonzero(r) for r in rows]
            terms = pa.array([m.astype(np.uint16).tobytes() for m in met], pa.binary())
            packed = pa.array([r[m].tobytes() for r, m in zip(rows, met)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), terms, packed], ["doc_id", "quality", "terms", "row"])

    sample = labelled_sample(docs, labels).mapInArrow(vectors, "doc_id long, quality int, terms binary, row binary").collect()
    sample.sort(key=lambda r: r["doc_id"])
    if not sample:
        return {"idf": idf, "project": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "votes": np.zeros(0, np.float32)}
    votes = np.array([r["quality"] for r in sample], np.float32)
    # right singular vectors through the small Gram matrix of the sample; the rows are unfolded anew
    # after it, so that the driver never holds them beside the work space of the decomposition
    x = _unfolded(sample)
    gram = (x @ x.T).astype(np.float64)
    del x
    values, left = np.linalg.eigh(gram)
    del gram
    best = np.argsort(-values)[:RANK]
    best = best[values[best] > 1e-6 * max(values.max(), 1e-12)]
    left = left[:, best]
    x = _unfolded(sample)
    project = (x.T @ (left / np.sqrt(values[best])).astype(np.float32)).astype(np.float32)
    return {"idf": idf, "project": project, "vectors": _unit(x @ project), "votes": votes}


def _unfolded(sample: list) -> np.ndarray:
    """The sample's rows of TERMS weights; they travel as the terms a text holds."""
    x = np.zeros((len(sample), TERMS), np.float32)
    for row, r in zip(x, sample):
        row[np.frombuffer(r["terms"], np.uint16)] = np.frombuffer(r["row"], np.float32)
    return x


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vote(rows: np.ndarray, model: dict[str, np.ndarray], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by squared positive cosine.

    Cosines are rounded to a grid and ties go to the vector that comes first, the one
    of the smaller doc_id. Without similar neighbours (an empty text) the share of
    label 1 in the sample; without a sample 0.5.
    """
    votes = model["votes"]
    if not len(votes):
        return np.full(len(rows), 0.5)
    k = min(neighbours, len(votes))
    # a block of one size whatever the number of rows: products are summed alike
    n = len(rows)
    if n < BLOCK:
        rows = np.concatenate([rows, np.zeros((BLOCK - n, rows.shape[1]), np.float32)])
    similar = (_unit(rows @ model["project"]) @ model["vectors"].T)[:n]
    steps = np.rint(similar * GRID).astype(np.int64)
    # one number tells nearness and place, so no two are equal
    place = steps * -len(votes)
    place += np.arange(len(votes))
    nearest = np.sort(np.argpartition(place, k - 1, axis=1)[:, :k], axis=1)
    weight = np.square(np.maximum(np.take_along_axis(steps, nearest, 1), 0) / GRID)
    total = weight.sum(1)
    return np.where(total > 1e-9, (weight * votes[nearest]).sum(1) / np.maximum(total, 1e-9), votes.mean())


def _scores(texts: list[str], model: dict[str, np.ndarray]) -> np.ndarray:
    blocks = [vote(tf_idf(term_counts(texts[at : at + BLOCK]), model["idf"]), model) for at in range(0, len(texts), BLOCK)]
    return np.clip(np.concatenate(blocks), 0, 1)


def keep(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            yield part.filter(pa.array(_scores(texts, shared.value) >= 0.5))

    return docs.mapInArrow(pick, docs.schema)


def classify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` without text, with ``score`` (0 to 1) and ``predicted``; every whole text is scored.

    The text alone decides: a null text is an empty one, equal texts score alike
    (but for a cosine that lies on the border of two grid steps to the last bit).
    """
    others = [c for c in docs.columns if c != "text"]
    if clash := {"score", "predicted"} & set(others):
        raise ValueError(f"columns of the result: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=SHORT_SLICE_BYTES):
            scores = _scores(texts, shared.value)
            out = pa.Table.from_batches([part]).select(others).append_column("score", pa.array(scores))
            yield from out.append_column("predicted", pa.array((scores >= 0.5).astype(np.int32))).to_batches()

    return docs.mapInArrow(rate, docs.select(*others).schema.add("score", "double").add("predicted", "integer"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out third."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return classify(docs, fit(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))
