"""Phrase collocations by the stripes pattern: a counter of next words under each prefix."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.batches import give_back, slices
from bookwise.llm.common import small, table, text_or_empty

LONGEST = 5
#: Least occurrences of a candidate.
LEAST = 100
#: A phrase goes if a longer one has at least this percentage of its occurrences.
SUBSUMED_PERCENT = 100
FIRST = 2000
#: A stripe is kept in so many pieces, by the hash of the next word, so that a common prefix is no single row.
SLOTS = 8
#: Positions a task counts before it sends its stripes on, and next words merged at a time.
HOLD = 1 << 22
HOLD_BYTES = 1 << 26
MERGE = 1 << 19
#: Bits of the filter of frequent phrases (8 MB whatever the corpus); what it lets through in error is counted and falls.
FILTER_BITS = 1 << 26
BREAK = b"."
_SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _SEPARATORS.encode(), b"abcdefghijklmnopqrstuvwxyz " + BREAK * len(_SEPARATORS)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)

_STRIPES = "lang string, prefix string, slot int, next array<string>, n array<long>"


def tokens(texts: list[str]) -> pa.Array:
    """The words of all texts end to end, as bytes; a break stands for the end of a piece."""
    joined = f" {BREAK.decode()} ".join([*texts, ""])
    letters = np.frombuffer(joined.encode().translate(_FOLD), np.uint8)
    blank, stop = letters == ord(" "), letters == BREAK[0]
    first = ~blank
    first[1:] &= blank[:-1] | stop[:-1] | stop[1:]
    offsets = np.append(np.flatnonzero(first[~blank]), len(letters) - np.count_nonzero(blank)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters[~blank])])


class Corpus:
    """Words of a task's texts of one language; numbered, the break is number 0."""

    def __init__(self, lang: str):
        self.lang, self.runs, self.size, self.bytes = lang, [pa.array([BREAK], pa.binary())], 0, 0

    def add(self, texts: list[str]) -> None:
        self.runs.append(tokens(texts))
        self.size += len(self.runs[-1])
        self.bytes += sum(map(len, texts))

    @functools.cached_property
    def _numbered(self) -> pa.DictionaryArray:
        return pa.concat_arrays(self.runs).dictionary_encode()

    @functools.cached_property
    def ids(self) -> np.ndarray:
        """The numbers of all words, a break at either end and no two breaks in a row."""
        ids = np.append(self._numbered.indices.to_numpy().astype(np.int64), 0)
        return ids[np.concatenate([[True], (ids[1:] != 0) | (ids[:-1] != 0)])]

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self._numbered.dictionary.to_pylist()

    @functools.cached_property
    def codes(self) -> np.ndarray:
        """A 64-bit hash of every word, different in every language."""
        seed = xxhash.xxh64_intdigest(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))


def spots(codes: list[np.ndarray]) -> np.ndarray:
    """The filter's bit for phrases given by the codes of their first, second, ... words."""
    mixed = codes[0]
    with np.errstate(over="ignore"):
        for c in codes[1:]:
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD + c
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    return (mixed >> np.uint64(20)).astype(np.int64) & (FILTER_BITS - 1)


def _ranks(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each row; equal rows have equal numbers."""
    rank = columns[0]
    for c in columns[1:]:
        rank = np.unique(rank * size + c, return_inverse=True)[1]
    return rank


def grams(corpus: Corpus, lengths: range, known: np.ndarray | None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Distinct phrases of each of ``lengths`` as columns of word numbers, with their counts.

    Pairs include the break as a second word, so the counts under a first word are
    all its occurrences. Longer phrases are made of frequent ones alone: all their
    runs of ``lengths[0]`` - 1 words are in the filter ``known``.
    """
    ids, size = corpus.ids, len(corpus.words)
    if known is None:
        at = np.flatnonzero(ids[:-1])
        pairs, n = np.unique(ids[at] * size + ids[at + 1], return_counts=True)
        yield [pairs // size, pairs % size], n
        return
    short = lengths[0] - 1
    codes = corpus.codes[ids]
    n_windows = len(ids) - short + 1
    windows = [codes[i : i + n_windows] for i in range(short)]
    bit = spots(windows)
    fits = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    for i in range(short):
        fits &= ids[i : i + n_windows] != 0
    for length in lengths:
        fits = fits[:-1] & fits[1:]
        at = np.flatnonzero(fits)
        columns = [ids[at + i] for i in range(length)]
        if len(at):
            _, first, n = np.unique(_ranks(columns, size), return_index=True, return_counts=True)
            yield [c[first] for c in columns], n


def stripes(corpus: Corpus, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    """Counts of phrases as stripes: next words and counts under (prefix, slot)."""
    slot = (corpus.codes % np.uint64(SLOTS)).astype(np.int64)[columns[-1]]
    order = np.lexsort((columns[-1], slot, *columns[-2::-1]))
    columns, slot, n = [c[order] for c in columns], slot[order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = slot[1:] != slot[:-1]
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(n)).astype(np.int32))
    names = pa.array([b"", *corpus.words[1:]], pa.binary()).cast(pa.string())
    prefix = [names.take(pa.array(c[first])) for c in columns[:-1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.repeat(pa.scalar(corpus.lang), len(first)),
            prefix[0] if len(prefix) == 1 else pc.binary_join_element_wise(*prefix, " "),
            pa.array(slot[first].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, names.take(pa.array(columns[-1]))),
            pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64))),
        ],
        ["lang", "prefix", "slot", "next", "n"],
    )


def _striped(lengths: range, known: object | None) -> Callable:
    """Stripes of the phrases of ``lengths`` words; ``known`` is the broadcast filter."""

    def striped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Corpus] = {}
        for part, texts in slices(batches):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                held.setdefault(lang, Corpus(lang)).add(own)
            if sum(c.size for c in held.values()) > HOLD or sum(c.bytes for c in held.values()) > HOLD_BYTES:
                yield from emptied(held)
        yield from emptied(held)
        give_back()

    def emptied(held: dict[str, Corpus]) -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            corpus = held.pop(lang)
            for columns, n in grams(corpus, lengths, None if known is None else known.value):
                if len(n):
                    whole = stripes(corpus, columns, n)
                    for i in range(0, whole.num_rows, 1 << 14):
                        yield whole.slice(i, 1 << 14)

    return striped


def merged(rows: list[pa.RecordBatch], least: int, totals: bool) -> pa.RecordBatch:
    """Elementwise sums of stripes: frequent extensions, and with ``totals`` the sum over each piece of a stripe (next is null)."""
    whole = pa.Table.from_batches(rows).combine_chunks()
    entry = pc.list_parent_indices(whole["next"])
    flat = pa.table({"lang": whole["lang"].take(entry), "prefix": whole["prefix"].take(entry), "next": pc.list_flatten(whole["next"]), "n": pc.list_flatten(whole["n"])})
    summed = flat.group_by(["lang", "prefix", "next"], use_threads=False).aggregate([("n", "sum")])
    frequent = pc.and_(pc.greater_equal(summed["n_sum"], least), pc.not_equal(summed["next"], ""))
    out = summed.filter(frequent).select(["lang", "prefix", "next", "n_sum"]).rename_columns(["lang", "prefix", "next", "n"])
    if totals:
        total = summed.group_by(["lang", "prefix"], use_threads=False).aggregate([("n_sum", "sum")])
        nothing = pa.nulls(total.num_rows, pa.string())
        out = pa.concat_tables([out, pa.table({"lang": total["lang"], "prefix": total["prefix"], "next": nothing, "n": total["n_sum_sum"]})])
    return out.combine_chunks().to_batches()[0] if out.num_rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in out.schema.types], out.schema.names)


def _merged(least: int, totals: bool) -> Callable:
    """Rows arrive sorted by (lang, prefix, slot), so all pieces of a key follow each other."""

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in ("lang", "prefix", "slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size > MERGE:
                # what continues the last key stays with it
                last, same = key(held[-1], held[-1].num_rows - 1), 0
                while same < batch.num_rows and key(batch, same) == last:
                    same += 1
                if same < batch.num_rows:
                    yield merged([*held, batch.slice(0, same)], least, totals)
                    held, size, batch = [], 0, batch.slice(same)
            held.append(batch)
            size += len(batch.column("next").flatten())
        if held:
            yield merged(held, least, totals)
        give_back()

    return run


def counted(docs: DataFrame, lengths: range, known: object | None, least: int) -> DataFrame:
    """(lang, prefix, next, n) of the frequent phrases of ``lengths`` words; for pairs also totals of prefixes."""
    rows = docs.mapInArrow(_striped(lengths, known), _STRIPES)
    rows = rows.repartition("lang", "prefix", "slot").sortWithinPartitions("lang", "prefix", "slot")
    return stage(rows.mapInArrow(_merged(least, known is None), "lang string, prefix string, next string, n long"), "phrases-stripes")


def frequent_filter(phrases: DataFrame) -> np.ndarray:
    """The filter's bytes for phrases (lang, prefix, next); its size is fixed."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.int64)]
        for batch in batches:
            for lang, prefix, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seed = xxhash.xxh64_intdigest(lang.encode())
                codes = [np.array([xxhash.xxh64_intdigest(w.encode(), seed)], np.uint64) for w in [*prefix.split(" "), last]]
                found.append(spots(codes))
        spot = np.unique(np.concatenate(found))
        if len(spot):
            at = np.unique(spot >> 3, return_index=True)
            byte = np.bitwise_or.reduceat((1 << (spot & 7)), at[1])
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(byte)], ["at", "byte"])

    held = phrases.select("lang", "prefix", "next").mapInArrow(bits, "at long, byte long")
    rows = held.groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    known = np.zeros(FILTER_BITS // 8, np.uint8)
    known[rows["at"].to_numpy()] = rows["byte"].to_numpy()
    return known


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All frequent phrases (lang, phrase, k, prefix, next, n) of 1 to 5 words, and (lang, n): all word occurrences.

    Three passes over the texts: pairs with the totals of their first words, then
    triples of frequent pairs, then phrases of 4 and 5 words of frequent triples.
    """
    context = docs.sparkSession.sparkContext
    pairs = counted(docs, range(2, 3), None, least)
    words = pairs.where("next IS NULL").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    words = stage(words, "phrases-words")
    found = [pairs.where("next IS NOT NULL")]
    for lengths in (range(3, 4), range(4, LONGEST + 1)):
        known = context.broadcast(frequent_filter(found[-1]))
        found.append(counted(docs, lengths, known, least))
    single = words.where(F.col("n") >= least).select("lang", F.col("prefix").alias("phrase"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("next"), "n")
    named = [single]
    for df in found:
        phrase = F.concat_ws(" ", "prefix", "next")
        named.append(df.select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("k"), "prefix", "next", "n"))
    every = named[0]
    for df in named[1:]:
        every = every.unionAll(df)
    return stage(every, "phrases-all"), words.groupBy("lang").agg(F.sum("n").alias("total"))


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by their weakest cut.

    Null text is empty and null lang ``und``; texts without words add nothing, an
    empty table gives no rows. Repeated rows count each for itself; other columns
    are never read. Ties in score fall to the more frequent phrase, then to UTF-8
    order. All arithmetic is exact.
    """
    read = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty("text").alias("text"))
    every, totals = phrase_counts(read, least)
    longer = every.where("k > 1")
    # of a phrase that continues a longer one the counter holds it; of one that ends it, its own last words
    right = longer.where("k > 2").select("lang", F.col("prefix").alias("phrase"), "n")
    words = F.split("phrase", " ")
    left = longer.where("k > 2").select("lang", _part(words, 2, F.col("k") - 1).alias("phrase"), "n")
    most = right.unionAll(left).groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = longer.join(most, ["lang", "phrase"], "left").where(F.expr(f"most IS NULL OR 100 * most < {SUBSUMED_PERCENT} * n"))

    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(words, 1, F.col("cut")).alias("head"), _part(words, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    heads = every.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = every.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    langs = totals.select("lang", F.col("total").alias("n"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(small(langs, langs.count()), "lang")
    # 19 digits hold any count, so both products keep all their digits
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    scored = cuts.withColumn("over", (wide["a"] * wide["n"]).cast("decimal(38,0)")).withColumn("under", (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    # floor(1000 x / y) from the quotient and the remainder: 1000 times a remainder stays inside 38 digits
    scored = scored.withColumn("score", F.expr("1000 * (over div under) + CAST(1000 AS DECIMAL(4,0)) * CAST(over % under AS DECIMAL(34,0)) div under"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("w")).select("lang", "phrase", "w.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))
