"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.common import local, part_of, ranked, small, table, text_or_empty, twins, word_count
from bookwise.llm.draws import even, splitting_tree

#: Weights of the sources in code point order, repeated; null is the last source.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MAX_REPEATS = 3
#: Passes along the permutation; each leaves a gap shorter than the row that stopped it.
FILLS = 3
#: Output shards of the mix.
SHARDS = 16
SEED = 9_001


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> list[float]:
    """Words due from each source: shares of all words by weight, none above ``most`` times its own size.

    What a capped source cannot give is shared again by weight. The fixed point
    caps the sources whose size per weight is smallest; sums are exact integers.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    rest, heavy = sum(sizes), sum(weight)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weight[i], i))
    capped: set[int] = set()
    for i in order:
        if most * sizes[i] * heavy > rest * weight[i]:
            break
        capped.add(i)
        rest -= most * sizes[i]
        heavy -= weight[i]
    return [float(most * sizes[i]) if i in capped else rest * weight[i] / heavy for i in range(len(sizes))]


def _same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _reached(run: DataFrame) -> DataFrame:
    """Words of the rows taken so far, per source."""
    return run.groupBy("sid").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("size"))), F.lit(0)).alias("reached"))


def _fill(run: DataFrame, n_sources: int) -> DataFrame:
    """Take, along each source's permutation, the longest prefix of the rows that still fit."""
    open_ = run.join(small(_reached(run), n_sources), "sid").withColumn("gap", F.col("rest") - F.col("reached"))
    open_ = open_.withColumn("fits", ~F.col("inside") & (F.col("size") <= F.col("gap")))
    open_ = open_.withColumn("step", F.when(F.col("fits"), F.col("size")).otherwise(0)).withColumn(
        "slice", F.shiftrightunsigned("pick", 56).cast("int")
    )
    sums = open_.groupBy("sid", "slice").agg(F.sum("step").alias("words"))
    before = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    along = Window.partitionBy("sid", "slice").orderBy("pick", "pick2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = open_.withColumn("along", F.sum("step").over(along)).join(small(starts, 256 * n_sources), ["sid", "slice"])
    taken = F.col("inside") | (F.col("fits") & (F.col("along") + F.col("start") <= F.col("gap")))
    return walked.withColumn("inside", taken).drop("reached", "gap", "fits", "step", "slice", "along", "start")


def mix(
    units: DataFrame, n_shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """Where each unit goes: the columns of ``units`` with twin, source_size, target, copies, taken and placements.

    ``units`` has ``source`` and ``size`` (words) and whatever identifies a row, under
    any names but those of the result, which are refused; rows equal in all columns
    are told apart by ``twin``. ``placements`` is an
    array of (shard, position), one for each copy taken, empty for none.

    1. Every source takes each of its rows floor(target / size) times. The rest of
       its target is filled along a random permutation of its rows: the longest
       prefix that does not exceed it, FILLS times, each time of the rows that
       still fit, and one further row if that brings the sum nearer.
    2. The counts of copies are the quotas of a tree over the output shards. Each
       node draws, multivariate hypergeometrically, how much of every source goes
       left; shard sizes are exact and differ by one at most.
    3. The copies of a source, permuted again, are cut into disjoint blocks by its
       column of leaf counts, and each shard shuffles what it received.

    The driver holds one row per source and n_shards counts for each. A source
    may hold any share of the rows: prefixes and blocks are found in hash slices.
    Null is a source of its own, the last one; a null or negative size is 0; an
    empty table gives no rows. The result depends on rows, seed and parameters alone.
    """
    spark = units.sparkSession
    if clash := {"twin", "source_size", "target", "copies", "taken", "placements"} & {c.lower() for c in units.columns}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    sized = units.withColumn("size", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long"))
    # the caller's columns travel as one, so that none of them meets a name used here
    rows = twins(sized.select(F.struct(*[F.col(f"`{c}`") for c in units.columns]).alias("unit"), "source", "size"))
    for k, name in enumerate(("pick", "pick2")):
        rows = rows.withColumn(name, F.xxhash64(F.lit(seed + k), "unit", "twin"))
    rows = stage(rows, "mix-rows")

    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))  # UTF-8 bytes sort by code point
    due = targets([r["size"] for r in found], weights, most)
    plan = []
    for i, (r, target) in enumerate(zip(found, due)):
        # an unreachable target (all sizes 0) takes nothing
        full = min(most, int(target // r["size"])) if r["size"] else 0
        rest = min(round(target) - full * r["size"], r["size"]) if full < most else 0
        plan.append((i, r["source"], r["size"], target, full, max(0, rest)))
    sources = local(
        spark, plan, "sid int, of_source string, source_size long, target double, full int, rest long"
    )
    sources = small(sources, len(plan))

    run = rows.join(sources, _same_source("source", "of_source")).drop("of_source", "source").withColumn("inside", F.lit(False))
    for _ in range(FILLS):
        run = stage(_fill(run, len(plan)), "mix-run")
    gaps = small(_reached(run), len(plan))
    # the one further row: nearest to what is missing, and nearer than nothing
    miss = F.abs(F.col("rest") - F.col("reached") - F.col("size"))
    near = (
        run.join(gaps, "sid").where(~F.col("inside") & (miss < F.col("rest") - F.col("reached")))
        .groupBy("sid").agg(F.min(F.struct(miss.alias("miss"), "pick", "pick2", "twin")).alias("extra"))
    )
    extra = F.col("pick").eqNullSafe(F.col("extra.pick")) & F.col("pick2").eqNullSafe(F.col("extra.pick2")) & F.col("twin").eqNullSafe(F.col("extra.twin"))
    more = (F.col("rest") > 0) & (F.col("inside") | F.coalesce(extra, F.lit(False)))
    chosen = run.join(small(near, len(plan)), "sid", "left").withColumn("copies", F.col("full") + more.cast("int"))
    chosen = stage(
        chosen.select("unit", "size", "twin", "sid", "source_size", "target", "copies", "pick", "pick2"), "mix-chosen"
    )

    quotas = dict(chosen.groupBy("sid").agg(F.sum("copies")).collect())
    quota = [quotas.get(i, 0) for i in range(len(plan))]
    leaves = splitting_tree(np.random.default_rng(seed), quota, even(sum(quota), n_shards))
    ends = local(
        spark, [(i, [int(x) for x in np.cumsum([leaf[i] for leaf in leaves])]) for i in range(len(plan))], "sid int, ends array<long>"
    )
    copies = chosen.where(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    for k, name in enumerate(("deal", "deal2", "place", "place2")):
        copies = copies.withColumn(name, F.xxhash64(F.lit(seed + 2 + k), "pick", "pick2", "twin", "copy"))
    dealt = ranked(copies, ["sid"], ["deal", "deal2"], groups=len(plan))
    dealt = dealt.join(small(ends, len(plan)), "sid").withColumn("shard", part_of(F.col("ends"), F.col("rank"))).drop("ends", "rank")
    placed = ranked(dealt, ["shard"], ["place", "place2"], groups=n_shards, rank="position")
    keys = ["unit", "size", "twin", "source_size", "target", "copies"]
    left_out = chosen.where(F.col("copies") == 0).select(*keys, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("position"))
    both = placed.select(*keys, "shard", "position").unionByName(left_out)
    spot = F.when(F.col("shard").isNotNull(), F.struct("shard", "position"))
    found = both.groupBy(*keys).agg(F.sort_array(F.collect_list(spot)).alias("placements"))
    return found.select(
        "unit.*", "twin", "source_size", "target", "copies", "placements", (F.size("placements") * F.col("size")).alias("taken")
    )


def identity(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_hash`` and ``size``, which with doc_id and source name a document without its text."""
    text = text_or_empty("text")
    return docs.select("*", F.xxhash64(text).alias("text_hash"), word_count("text").alias("size"))


def mixed_documents(docs: DataFrame, n_shards: int = SHARDS, block: int = 65_536) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as taken, by shard and position.

    ``docs`` has doc_id, source and text; other columns are carried. Each text
    moves twice: to its placements, and to its place.
    """
    columns = docs.columns
    keys = ["doc_id", "source", "size", "text_hash"]
    known = docs.select("doc_id", "source", "text").transform(identity).select(*keys)
    places = mix(known, n_shards).where(F.size("placements") > 0).select(*keys, "twin", "placements")
    tagged = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", "text").transform(identity).select("row", *keys)
    # only rows whose key repeats are numbered, by a sort of those alone
    again = stage(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys), "mix-again")
    n_again = again.count()
    if n_again:
        several = small(again.withColumn("several", F.lit(True)), n_again)
        marked = tagged.join(several, [tagged[k].eqNullSafe(several[k]) for k in keys], "left").select("row", *[tagged[k] for k in keys], "several")
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("row"))
        twins_ = marked.where("several").select("row", *keys, (F.row_number().over(order) - 1).alias("twin"))
        tagged = marked.where("several IS NULL").select("row", *keys, F.lit(0).alias("twin")).unionByName(twins_)
    else:
        tagged = tagged.withColumn("twin", F.lit(0))
    same = [tagged[k].eqNullSafe(places[k]) for k in (*keys, "twin")]
    # hashed on the places, so that no side is sorted with its texts
    taken = tagged.join(places.hint("shuffle_hash"), same).select("row", F.explode("placements").alias("to"))
    spread = taken.select("row", F.col("to.shard").alias("shard"), F.col("to.position").alias("position"))
    spread = spread.withColumn("block", F.floor(F.col("position") / block))
    return spread.repartition("shard", "block").sortWithinPartitions("shard", "position").select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the weighted mix of all sources takes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    units = identity(docs).select("doc_id", "source", "size", "text_hash")
    return mix(units).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.col("taken").cast("long").alias("taken"), F.col("placements"),
    )
