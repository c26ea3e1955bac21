"""Customer search for a set of query texts: exact, then fuzzy for what found nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from bookwise import constants as K
from bookwise.functions.columns import top_rows
from bookwise.functions.contains import PieceIndex, is_plain, least_length, longest_literal, matching_literal, piece_index
from bookwise.functions.names import first_word, jaccard, overlap, phonetic_key, trigrams
from bookwise.functions.staging import stage
from bookwise.operators.customer import with_figures

#: Customers of a sound that one task scores together; a commoner sound is spread over more.
SOUND_BLOCK = 2_000


@dataclass(frozen=True)
class NameIndex:
    """What a search reads, staged once for a customer dimension and its figures.

    ``leaders`` (customer_name, customer_id, sales_12m) are the customers of each name
    that can be among the first ten of a search. ``by_piece`` and ``by_length`` hold
    the first ten customers whose name has a piece of one or two characters, or has
    at least a length: short queries and wildcards are answered from there.
    """

    dim: DataFrame
    figures: DataFrame
    names: PieceIndex
    leaders: DataFrame
    by_piece: DataFrame
    by_length: DataFrame


def _biggest_first():
    return [F.col("sales_12m").desc_nulls_last(), F.col("customer_name").asc(), F.col("customer_id").asc()]


def name_index(dim: DataFrame, figures: DataFrame) -> NameIndex:
    slim = with_figures(dim.select("customer_id", "customer_name"), figures).drop("last_invoice")
    leaders = stage(top_rows(slim.where("customer_name IS NOT NULL"), ["customer_name"], _biggest_first(), K.EXACT_ROWS), "leaders")
    names = piece_index(leaders, "customer_name")
    short = names.postings.where("length(piece) < 3").select("piece", F.col("text").alias("customer_name")).join(leaders, "customer_name")
    by_piece = stage(top_rows(short, ["piece"], _biggest_first(), K.EXACT_ROWS), "top-by-piece")
    # the first ten of each length, offered to every smaller length
    sized = top_rows(leaders.withColumn("size", F.length("customer_name")), ["size"], _biggest_first(), K.EXACT_ROWS)
    reach = sized.withColumn("least", F.explode(F.sequence(F.lit(0), F.col("size")))).drop("size")
    by_length = stage(top_rows(reach, ["least"], _biggest_first(), K.EXACT_ROWS), "top-by-length")
    return NameIndex(dim, figures, names, leaders, by_piece, by_length)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.trim("query").alias("query")).where("query IS NOT NULL").distinct()


def _exact_leaders(index: NameIndex, asked: DataFrame) -> DataFrame:
    """(query, customer_name, customer_id, sales_12m): by id or by ``name ILIKE %query%``, at least the first ten of each query."""
    columns = ["query", "customer_name", "customer_id", "sales_12m"]
    known = index.dim.select("customer_id", "customer_name")
    ids = with_figures(asked.join(known.withColumn("query", F.col("customer_id")), "query"), index.figures)
    kinds = asked.withColumn("literal", longest_literal())
    short = is_plain() & (F.length("literal") < 3)
    brief = kinds.where(short).withColumnRenamed("literal", "piece").join(index.by_piece, "piece")
    wild = kinds.where("literal IS NULL").withColumn("least", least_length()).join(index.by_length, "least")
    rest = matching_literal(index.names, kinds.where(F.col("literal").isNotNull() & ~short).select("query"))
    named = rest.withColumnRenamed("text", "customer_name").join(index.leaders, "customer_name")
    found = ids.select(*columns)
    for df in (brief, wild, named):
        found = found.unionByName(df.select(*columns))
    return found.distinct()


def find_customer(dim: DataFrame, figures: DataFrame, queries: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """Exact path: the ten biggest customers whose name contains the query, or whose id it is.

    Matches carry name, id and sales until ten are left; only those meet the dimension.
    """
    index = index or name_index(dim, figures)
    best = top_rows(_exact_leaders(index, _asked(queries)), ["query"], _biggest_first(), K.EXACT_ROWS)
    named = with_figures(best.select("query", "customer_id").join(index.dim, "customer_id"), index.figures)
    return named.select(
        "query", "customer_id", "customer_name", "customer_class", "salesrep_name", "address", "city", "state", "zip",
        "phone", "sales_12m", "last_invoice",
    )


def _trigram_matches(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs with Jaccard similarity of the trigram sets above the threshold.

    A pair at 0.2 or more shares at least a fifth of the query's trigrams, so it
    shares one of the query's rarest ``size - ceil(size / 5) + 1``: only those are
    looked up, and the commonest trigrams never spread their name lists.
    """
    listed = names.select("customer_id", "name_trigrams", F.explode("name_trigrams").alias("trigram"))
    frequency = listed.groupBy("trigram").agg(F.count(F.lit(1)).alias("names"))
    ranked = (
        asked.select("query", "query_trigrams", F.explode("query_trigrams").alias("trigram"))
        .join(frequency, "trigram")
        .withColumn("size", F.size("query_trigrams"))
    )
    # trigrams no name has are the rarest of all and count as looked up
    missing = F.col("size") - F.size("found")
    wanted = F.col("size") - F.ceil(F.col("size") / 5).cast("int") + 1 - missing
    probes = (
        ranked.groupBy("query", "query_trigrams", "size")
        .agg(F.array_sort(F.collect_list(F.struct("names", "trigram"))).alias("found"))
        .select("query", "query_trigrams", F.explode(F.slice("found", F.lit(1), F.greatest(wanted, F.lit(0)))).alias("probe"))
        .select("query", "query_trigrams", F.col("probe.trigram").alias("trigram"))
    )
    sizes = F.size("name_trigrams").between(F.size("query_trigrams") / 5, F.size("query_trigrams") * 5)
    candidates = probes.join(listed, "trigram").where(sizes)
    common = overlap(F.col("query_trigrams"), F.col("name_trigrams"))
    similarity = jaccard(common, F.col("query_trigrams"), F.col("name_trigrams"))
    return candidates.where(similarity > K.MIN_NAME_SIMILARITY).select("query", "customer_id").distinct()


def sounds(texts: DataFrame, column: str) -> DataFrame:
    """(word, sound): the phonetic code of every distinct first word of ``column``."""
    words = texts.select(first_word(column).alias("word")).where("word IS NOT NULL").distinct()
    return words.select("word", phonetic_key("word").alias("sound"))


def _sounding_alike(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, customer_id) of names whose first word sounds like the query's.

    Codes are made per distinct word. The customers of a common sound are cut into
    blocks of about SOUND_BLOCK, so no sound is one task however many share it.
    """
    words = stage(sounds(names, "customer_name"), "sounds")
    heard = names.select("customer_id", first_word("customer_name").alias("word")).join(words, "word").drop("word")
    sizes = heard.groupBy("sound").agg(F.ceil(F.count(F.lit(1)) / SOUND_BLOCK).cast("int").alias("blocks"))
    sizes = stage(sizes, "sound-sizes")
    said = asked.select("query", first_word("query").alias("word")).join(sounds(asked, "query"), "word")
    said = said.join(sizes, "sound").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = heard.join(sizes, "sound").withColumn("block", F.pmod(F.xxhash64("customer_id"), F.col("blocks")).cast("int"))
    return said.join(spread.drop("blocks"), ["sound", "block"]).select("query", "customer_id")


def fuzzy_customer(dim: DataFrame, figures: DataFrame, queries: DataFrame) -> DataFrame:
    """Names that look or sound like each query, best eight; every row carries a note.

    Pairs carry id, similarity and sales until eight are left; only those meet the dimension.
    """
    asked = _asked(queries).where(F.length("query") >= K.FUZZY_MIN_LENGTH)
    asked = asked.withColumn("query_trigrams", trigrams("query"))
    names = dim.select("customer_id", "customer_name", trigrams("customer_name").alias("name_trigrams"))
    names = stage(with_figures(names, figures).drop("last_invoice"), "fuzzy-names")
    pairs = _trigram_matches(names, asked).unionByName(_sounding_alike(names, asked)).distinct()
    common = overlap(F.col("query_trigrams"), F.col("name_trigrams"))
    whole = F.size("query_trigrams") + F.size("name_trigrams") - common
    shown = F.round(F.try_divide(common.cast("decimal(10,0)"), whole.cast("decimal(10,0)")), 2)
    scored = (
        pairs.join(asked, "query")
        .join(names, "customer_id")
        .select("query", "customer_id", "sales_12m", F.coalesce(shown, F.lit(0).cast("decimal(3,2)")).alias("name_similarity"))
    )
    order = [
        F.col("name_similarity").desc(), F.col("sales_12m").desc_nulls_last(), F.col("customer_id").asc(),
    ]
    best = top_rows(scored, ["query"], order, K.FUZZY_ROWS)
    return best.join(dim, "customer_id").select(
        "query", "customer_id", "customer_name", "customer_class", "salesrep_name", "city", "state", "sales_12m",
        "name_similarity", F.lit(K.FUZZY_NOTE).alias("note"),
    )


def search_customer(dim: DataFrame, figures: DataFrame, queries: DataFrame, index: NameIndex | None = None) -> DataFrame:
    """Exact rows for each query, fuzzy rows where there are none (``note`` tells which)."""
    exact = stage(find_customer(dim, figures, queries, index), "exact-names")
    missed = _asked(queries).join(exact.select("query").distinct(), "query", "left_anti")
    fuzzy = fuzzy_customer(dim, figures, stage(missed, "missed"))
    return exact.unionByName(fuzzy, allowMissingColumns=True)
