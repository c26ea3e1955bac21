"""Which texts contain a query: an index of distinct texts by their pieces of one to three characters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from bookwise.functions.staging import stage

#: Characters of the longest piece.
PIECE = 3


def pieces(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; empty for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    cut = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def pattern() -> Column:
    # a backslash before an ordinary character stands for that character
    literal = F.regexp_replace("query", r"(\\[%_\\])|\\(.)", "$1$2")
    return F.concat(F.lit("%"), literal, F.lit("%"))


def longest_literal() -> Column:
    """Longest stretch of the query without a wildcard, lower-cased; NULL if there is none."""
    runs = F.regexp_extract_all("query", F.lit(r"((?:[^%_\\]|\\.)+)"), F.lit(1))
    plain = F.transform(runs, lambda run: F.lower(F.regexp_replace(run, r"\\(.)", "$1")))
    return F.try_element_at(F.array_sort(plain, lambda a, b: F.length(b) - F.length(a)), F.lit(1))


def is_plain() -> Column:
    """The query has neither wildcards nor escapes."""
    return ~F.col("query").rlike(r"[%_\\]")


def least_length() -> Column:
    """Characters a text needs at least to match a query of wildcards alone."""
    return F.length(F.regexp_replace("query", "[^_]", ""))


@dataclass(frozen=True)
class PieceIndex:
    """``texts`` (text, lowered); ``postings`` (piece, text, lowered); ``counts`` (piece, texts). All are staged."""

    texts: DataFrame
    postings: DataFrame
    counts: DataFrame


def piece_index(texts: DataFrame, column: str) -> PieceIndex:
    """Index the distinct values of ``column``; NULL matches nothing and stays out."""
    distinct = texts.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct()
    distinct = stage(distinct.withColumn("lowered", F.lower("text")), "texts")
    every = F.flatten(F.array(*[pieces(F.col("lowered"), n) for n in range(1, PIECE + 1)]))
    postings = stage(distinct.select(F.explode(every).alias("piece"), "text", "lowered"), "postings")
    counts = stage(postings.groupBy("piece").agg(F.count(F.lit(1)).alias("texts")), "piece-counts")
    return PieceIndex(distinct, postings, counts)


def rarest_piece(asked: DataFrame, keys: list[str], words: Column, index: PieceIndex) -> DataFrame:
    """(keys, piece): of all pieces of an asked row's lower-cased ``words``, the one that the fewest texts hold.

    A word of three characters or more is cut into pieces of three, a shorter one is
    a piece itself. A row with a piece that no text holds matches nothing and drops out.
    """
    longest = F.transform(words, lambda w: F.when(F.length(w) < PIECE, F.array(w)).otherwise(pieces(w, PIECE)))
    listed = asked.select(*keys, F.explode(F.flatten(longest)).alias("piece")).join(index.counts, "piece", "left")
    best = listed.groupBy(*keys).agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("best"))
    return best.where("best.texts > 0").select(*keys, F.col("best.piece").alias("piece"))


def matching_literal(index: PieceIndex, asked: DataFrame) -> DataFrame:
    """(query, text): texts that contain a ``query`` with a literal stretch.

    A text that contains the query contains each piece of its literal stretch, so
    texts meet queries on the rarest of them and are checked after that.
    """
    known = asked.withColumn("literal", longest_literal()).where("literal IS NOT NULL").withColumn("plain", is_plain()).withColumn("pattern", pattern())
    probes = rarest_piece(known, ["query", "literal", "plain", "pattern"], F.array("literal"), index)
    fits = (F.col("plain") & F.contains("lowered", "literal")) | (~F.col("plain") & F.expr("text ILIKE pattern"))
    return probes.join(index.postings, "piece").where(fits).select("query", "text")


def matching_wildcards(index: PieceIndex, asked: DataFrame) -> DataFrame:
    """(query, text): texts long enough for a ``query`` of wildcards alone.

    Lengths meet lengths: every length of a text lists the lengths up to it.
    """
    wild = asked.where(longest_literal().isNull()).withColumn("least", least_length())
    sized = index.texts.select("text", F.length("text").alias("size"))
    reach = sized.select("size").distinct().select("size", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("least"))
    return wild.join(reach, "least").join(sized, "size").select("query", "text")
