"""Look-alike customers by purchase mix, and the product-group gaps against peers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from bookwise import constants as K
from bookwise.context import Settings
from bookwise.functions.columns import clamp, percent, restrict, top_rows
from bookwise.functions.staging import stage
from bookwise.operators.alike import LEAF, TWIG, UNITS, Best, Mixes, Tally, arrange, best_peers, matches, spread
from bookwise.operators.views import customer_vector

# Customers that travel in one row, packed; a quarter of it on the subjects' side.
BLOCK = 4_096
# Tasks that compare, unless there are so many subjects that one would hold more than SUBJECTS.
BLOCKS = 32
SUBJECTS = 1 << 17
# Customers that are arranged together: a leaf of subjects, a twig of peers.
_RUN = LEAF
# Peers that pass at once: as many as a task has met, between these two.
_PEERS = 512, 1 << 17
# dense cells a task holds at a time
_CELLS = 1 << 20
# What rounding the weights can add to a similarity, generously.
_SLACK = 1e-5


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """(customer_id, places, w, cents, leads): a customer's whole mix, its rarest product group first.

    ``places`` numbers the groups by how few customers buy them, the same for
    everybody. ``leads`` is the prefix under which a customer is indexed: the groups
    from which on its weights still have a norm of MIN_SIMILARITY. What two customers
    share beyond the prefix of either cannot reach that similarity, and the rarest
    group they share comes first, so similar customers have it in both prefixes.
    NULL groups match nothing, as in an equi-join.
    """
    known = vectors.where("product_group_id IS NOT NULL")
    buyers = known.groupBy("product_group_id").agg(F.count(F.lit(1)).alias("buyers"))
    # one row per product group, a dimension
    rarity = buyers.select("product_group_id", F.row_number().over(Window.orderBy("buyers", "product_group_id")).alias("place"))
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("customer_id").orderBy(F.desc("place")))
    entry = F.struct(
        "place",
        F.round(F.col("w") * UNITS, 0).alias("w"),
        # cents as integers: exact sums inside numpy
        (F.col("sales_12m") * 100).cast("long").alias("cents"),
        (F.sqrt("rest") >= K.MIN_SIMILARITY - _SLACK).alias("leads"),
    )
    placed = known.join(rarity, "product_group_id").withColumn("rest", rest)
    mix = placed.groupBy("customer_id").agg(F.array_sort(F.collect_list(entry)).alias("mix"))
    return mix.select(
        "customer_id", F.col("mix.place").alias("places"), F.col("mix.w").alias("w"), F.col("mix.cents").alias("cents"),
        F.transform(F.filter("mix", lambda e: e["leads"]), lambda e: e["place"]).alias("leads"),
    )


def _alike() -> list[Column]:
    """An order in which customers that buy much the same follow each other: dearest groups, and how dear."""
    dear = F.slice(F.sort_array(F.arrays_zip("w", "places"), asc=False), 1, 3)

    def place(k: int) -> Column:
        return F.try_element_at(dear, F.lit(k))["places"]

    def share(k: int) -> Column:
        unit = F.try_element_at(dear, F.lit(k))["w"] / UNITS
        return F.floor(unit * unit * 8)

    return [place(1), share(1), place(2), share(2), place(3), F.col("rank")]


def _packed_rows(rows: DataFrame, order: list[Column], size: int, together: int = 0) -> DataFrame:
    """(first, members, packed): the rows in this order, up to ``size`` of them packed in one, arranged by ``together``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = pa.Table.from_batches([batch.slice(start, size)])
                if together:
                    part = part.take(pa.array(arrange(part, together)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(part.combine_chunks())
                row = {"first": [part["rank"][0].as_py()], "members": [part.num_rows], "packed": [sink.getvalue().to_pybytes()]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("first", pa.int64()), ("members", pa.int64()), ("packed", pa.binary())]))

    # as columns, or the sort would work them out anew for each comparison
    keys = {f"order_{k}": column for k, column in enumerate(order)}
    return rows.withColumns(keys).orderBy(*keys).drop(*keys).mapInArrow(pack, "first long, members long, packed binary")


def _unpacked(row: bytes) -> pa.Table:
    return pa.ipc.open_stream(row).read_all().combine_chunks()


class _Comparison:
    """The n most similar customers of each subject, found in tasks that peers pass.

    Customers travel packed, BLOCK in a row, those that buy much the same together. A task
    holds a block of subjects and lets all peers pass once for the best n of each; then
    they pass once more in the order of their ids, with what is to be told of them, so that
    no pair is shuffled or joined. The number of tasks, and with it of copies of the peers,
    grows only beyond BLOCKS * SUBJECTS subjects; few subjects are copied instead and each
    copy meets a part of the peers (``whole`` is False: the best n of all are yet to be kept).
    """

    def __init__(self, vectors: DataFrame, subjects: DataFrame | None, n: int, population: DataFrame | None = None):
        self.n, self.subjects = n, subjects
        mixes = packed_vectors(vectors).select("customer_id", "places", F.col("w").cast("array<int>").alias("w"), "cents")
        if population is None:
            mixes = mixes.withColumn("peer", F.lit(True))
        else:
            known = population.select("customer_id").distinct().withColumn("known", F.lit(True))
            mixes = mixes.join(known, "customer_id", "left").withColumn("peer", F.col("known").isNotNull()).drop("known")
        # the rank of an id among all, so that ties need no text
        self.mixes = stage(mixes.orderBy("customer_id").withColumn("rank", F.monotonically_increasing_id()), "vectors")
        self.wanted = restrict(self.mixes, None if subjects is None else subjects.select("customer_id").distinct())
        asked = self.wanted.count()
        self.rows = max(-(-asked // SUBJECTS), min(BLOCKS, -(-asked // BLOCK)), 1)
        self.columns = max(1, BLOCKS // self.rows)
        self.whole = self.columns == 1

    def told(self, finish: Callable[..., Iterator[pa.Table]], schema: str, about: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
        """What ``finish`` makes of (subjects, the best, tables of peers, each in the order of their ids).

        ``about`` has what is told of peers by customer_id, beside their mixes, and ``own`` what
        is known of subjects; both only where ``whole`` is True.
        """
        size, cells, passing, n = BLOCK, _CELLS, _PEERS, self.n
        rows, columns = self.rows, self.columns
        peers = self.mixes.where("peer").drop("peer")
        wanted = self.wanted.select("customer_id", "rank", "peer", "places", "w")
        wanted = wanted if own is None else wanted.join(own, "customer_id", "left")
        shown = peers.drop("w") if about is None else peers.drop("w").join(about, "customer_id")
        subjects = stage(_packed_rows(wanted, _alike(), max(1, size // 4), _RUN), "subject-blocks")
        if self.whole:
            slim = stage(_packed_rows(peers.select("rank", "places", "w"), _alike(), size, TWIG), "peer-blocks")
            sides = [subjects, slim, stage(_packed_rows(shown, [F.col("rank")], size), "peers-shown")]
        else:  # a task tells of the peers that it compares
            told = stage(_packed_rows(peers, _alike(), size, TWIG), "peer-blocks")
            sides = [subjects, told, told]

        def copies(side: int, others: int, task: Callable[[Column, Column], Column]) -> DataFrame:
            mine = F.pmod(F.xxhash64("first"), F.lit(columns if side else rows))
            spread = sides[side].withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
            return spread.select(task(F.col("mine"), F.col("other")).cast("int").alias("task"), F.lit(side).alias("side"), "first", "packed")

        both = copies(0, columns, lambda row, column: row * columns + column)
        for side in (1, 2):
            both = both.unionAll(copies(side, rows, lambda column, row: row * columns + column))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("task", "side", "packed"))))
            for _, of_task in groupby(sent, itemgetter(0)):
                by_side = groupby(of_task, itemgetter(1))
                side, first = next(by_side)
                if side:
                    continue
                subject_rows = pa.concat_tables([_unpacked(row[2]) for row in first])
                side, second = next(by_side, (2, ()))
                if side != 1:
                    continue
                best = best_peers(subject_rows, (_unpacked(row[2]) for row in second), n, passing, cells)
                third = (_unpacked(row[2]).sort_by("rank") for _, rest in by_side for row in rest)
                for found in finish(subject_rows, best, third):
                    yield from found.to_batches(max_chunksize=10_000)

        dealt = both.repartitionById(rows * columns, F.col("task")).sortWithinPartitions("task", "side", "first")
        return dealt.mapInArrow(compare, schema)


def _pair_rows(columns: list[str]) -> Callable[[pa.Table, Best, Iterable[pa.Table]], Iterator[pa.Table]]:
    """Each pair as a row, with these columns of the peer."""

    def rows(subject_rows: pa.Table, best: Best, shown: Iterable[pa.Table]) -> Iterator[pa.Table]:
        pairs, ids = best.pairs(), subject_rows["customer_id"].combine_chunks()
        for block in shown:
            mixes = Mixes(block, ("cents",))
            cents = mixes.values["cents"].to_numpy()
            for part, peer, pair in pairs.of(block["rank"].to_numpy(), 1 << 16):
                s = pairs.s[part][pair]
                told = {"subject_id": ids.take(pa.array(s)), "raw": pairs.raw[part][pair], "cents": pairs.shared(s, mixes, cents, peer)}
                yield pa.table({**told, **{c: block[c].take(pa.array(peer)) for c in columns}})

    return rows


def _dollars(cents: Column, precision: int = 28) -> Column:
    return (cents.cast("decimal(26,0)") / 100).cast(f"decimal({precision},2)")


def similar_pairs(vectors: DataFrame, subjects: DataFrame | None, n: int = K.LOOKALIKES, population: DataFrame | None = None) -> DataFrame:
    """The n most similar customers of each subject: (subject_id, customer_id, raw, sales_12m).

    Peers are the customers of ``population`` (None: everybody in ``vectors``);
    ``sales_12m`` is the peer's sales in the groups the subject buys too. One exact
    path for any number of subjects.
    """
    return _pairs(_Comparison(vectors, subjects, n, population))


def _pairs(comparison: _Comparison) -> DataFrame:
    pairs = comparison.told(_pair_rows(["customer_id"]), "subject_id string, raw double, cents long, customer_id string")
    pairs = pairs.select("subject_id", "customer_id", "raw", _dollars(F.col("cents")).alias("sales_12m"))
    if comparison.whole:
        return pairs
    return top_rows(pairs, ["subject_id"], [similarity().desc(), F.col("customer_id").asc()], comparison.n)


def similarity() -> Column:
    """Similarity on three places, by the same floating-point steps as the blocks."""
    return F.floor(F.col("raw") * 1000 + 0.5) / 1000


def _compare_block(subject_rows: pa.Table, peer_rows: pa.Table | Iterable[pa.Table], n: int) -> pa.Table:
    """Best n peers of each subject, by thousandths then place; without ranks the rows of both are the same."""
    peer_rows = [peer_rows] if isinstance(peer_rows, pa.Table) else peer_rows
    pairs = best_peers(subject_rows, peer_rows, n, _PEERS, _CELLS).pairs()
    return pa.table({"subject_id": subject_rows["customer_id"].take(pa.array(pairs.s)), "rank": pairs.rank, "raw": pairs.raw})


def lookalikes(
    pg12: DataFrame,
    customer_dim: DataFrame,
    subjects: DataFrame | None,
    n: int = K.LOOKALIKES,
    show_sales: bool = True,
) -> DataFrame:
    """Top n customers with the most alike 12-month mix, per subject.

    Peers are the customers of ``customer_dim`` in ``pg12``; pass only subjects the
    caller may see. A caller who does not see all gets NULL peer sales.
    """
    comparison = _Comparison(customer_vector(pg12), subjects, n, customer_dim)
    named = customer_dim.select("customer_id", "customer_name", "customer_class")
    if comparison.whole:
        columns = ["customer_id", "customer_name", "customer_class"]
        told = comparison.told(
            _pair_rows(columns), "subject_id string, raw double, cents long, customer_id string, customer_name string, customer_class string", named
        )
        pairs = told.withColumn("sales_12m", _dollars(F.col("cents")))
    else:
        pairs = _pairs(comparison).join(named, "customer_id")
    sales = F.round("sales_12m", 0) if show_sales else F.lit(None).cast("decimal(28,0)")
    return pairs.select(
        "subject_id",
        "customer_id",
        "customer_name",
        "customer_class",
        similarity().alias("similarity"),
        sales.alias("sales_12m"),
    )


def _named(pg12: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, rows by name): a name is its place among all names, so that the largest is found without text."""
    # one row per product group and name, a dimension
    every = pg12.select("product_group_id", "product_group_desc").distinct()
    places = Window.orderBy(F.col("product_group_desc").asc_nulls_first(), F.col("product_group_id").asc_nulls_first())
    names = stage(every.select("*", F.row_number().over(places).alias("name")), "group-names")
    same = F.col("o.product_group_id").eqNullSafe(F.col("k.product_group_id")) & F.col("o.product_group_desc").eqNullSafe(F.col("k.product_group_desc"))
    return names, pg12.alias("o").join(names.alias("k"), same).select("customer_id", "k.product_group_id", "name", "sales_12m")


def gaps_of_pairs(pairs: DataFrame, pg12: DataFrame, ltd: DataFrame, min_pct: float) -> DataFrame:
    """Groups that at least ``min_pct`` percent of a subject's peers bought and it did not.

    ``pg12`` has one row per customer and group, so counting rows counts buyers.
    """
    found = pairs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("lookalikes"))
    names, named = _named(pg12)
    # a peer's groups travel as one row, pairs once to their peers and once back to their subjects
    mixes = named.groupBy("customer_id").agg(F.collect_list(F.struct("product_group_id", "name", "sales_12m")).alias("mix"))
    bought = (
        pairs.select("subject_id", "customer_id").join(mixes, "customer_id").select("subject_id", "mix")
        .repartition("subject_id")
        .select("subject_id", F.inline("mix"))
        .groupBy("subject_id", "product_group_id")
        .agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("lookalike_buyers"), F.sum("sales_12m").alias("sales"))
    )
    names = names.select("name", "product_group_desc")
    subjects = found.select(F.col("subject_id").alias("customer_id"))
    own = restrict(pg12, subjects).select(F.col("customer_id").alias("subject_id"), "product_group_id")
    before = restrict(ltd, subjects).select(
        F.col("customer_id").alias("subject_id"),
        "product_group_id",
        F.col("sales_ltd"),
        F.col("last_invoice_date").alias("my_last_purchase"),
        F.lit(True).alias("bought"),
    )
    keys = ["subject_id", "product_group_id"]
    share = percent(F.col("lookalike_buyers"), F.col("lookalikes"))
    gaps = (
        bought.join(found, "subject_id")
        .where(share >= F.lit(str(min_pct)).cast("decimal(12,4)"))
        .join(own, keys, "left_anti")
        .join(names, "name")
        .join(before, keys, "left")
        .select(
            *keys,
            "product_group_desc",
            "lookalike_buyers",
            "lookalikes",
            F.round(share, 1).alias("penetration_pct"),
            F.round(F.try_divide("sales", "lookalike_buyers"), 0).alias("avg_sales_per_buyer"),
            F.round(F.coalesce("sales_ltd", F.lit(0).cast("decimal(28,2)")), 0).alias("my_lifetime_sales"),
            "my_last_purchase",
            F.when(F.col("bought").isNull(), K.NEVER_BOUGHT).otherwise(K.BOUGHT_BEFORE).alias("status"),
        )
    )
    order = [
        F.col("penetration_pct").desc_nulls_first(),
        F.col("avg_sales_per_buyer").desc_nulls_first(),
        F.col("product_group_id").asc(),
    ]
    return top_rows(gaps, ["subject_id"], order, K.GAP_ROWS)


def _gap_lists(ids: list, descs: list, min_pct: float, shown: int) -> Callable[[pa.Table, Best, Iterable[pa.Table]], Iterator[pa.Table]]:
    """A row per subject with look-alikes: its first ``shown`` of them and its gaps, as lists.

    ``ids`` and ``descs`` are the product group and text of each name, the first name's first.
    """
    first: dict = {}
    # a group goes by its first name
    group_of = np.array([0] + [first.setdefault(g, k) for k, g in enumerate(ids, 1)], np.int64)
    missing = first.get(None, -1)
    width = len(ids) + 1

    def keys(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        lists = rows[column].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64)

    def rows(subject_rows: pa.Table, best: Best, told: Iterable[pa.Table]) -> Iterator[pa.Table]:
        subject_rows = subject_rows.combine_chunks()
        pairs, tally, heads = best.pairs(), Tally(), []
        for block in told:
            mixes, cents = Mixes(block, ("cents",)), block["cents"].combine_chunks()
            row, name = keys(block, "bought")
            amounts = block["amounts"].combine_chunks()
            amounts = (amounts.chunk(0) if isinstance(amounts, pa.ChunkedArray) else amounts).flatten()
            valid = amounts.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            amounts = amounts.fill_null(0).to_numpy()
            sizes = np.bincount(row, minlength=block.num_rows)
            starts = np.cumsum(sizes) - sizes
            for part, peer, pair in pairs.of(block["rank"].to_numpy(), 1 << 16):
                s = pairs.s[part][pair].astype(np.int64)
                at = spread(starts[peer], sizes[peer])
                key = np.repeat(s, sizes[peer]) * width + group_of[name[at]]
                tally.add(key, np.ones(len(at), np.int64), amounts[at], valid[at], name[at])
                if shown:
                    place = pairs.place(part)[pair]
                    head = np.flatnonzero(place < shown)
                    s, peer, pair, place = s[head], peer[head], pair[head], place[head]
                    shared = pairs.shared(s, mixes, mixes.values["cents"].to_numpy(), peer)
                    heads.append(
                        pa.table(
                            {
                                "s": s, "place": place, "who": block["who"].take(pa.array(peer)),
                                "raw": pairs.raw[part][pair], "cents": shared,
                            }
                        )
                    )
        count = len(best.mixes)
        found = np.bincount(pairs.s, minlength=count)
        key, buyers, cents, valid, name = tally.total()
        s, group = key // width, key % width
        who, own = keys(subject_rows, "own")
        own = who * width + group_of[own]
        own = own[own % width != missing]
        # a little too many: the exact share is judged later
        kept = (100.0 * buyers >= (min_pct - 1e-3) * found[s]) & (matches(key, own) < 0)
        key, buyers, cents, valid, name, s, group = (c[kept] for c in (key, buyers, cents, valid, name, s, group))
        who, past = keys(subject_rows, "past_group")
        at = matches(key, who * width + past)
        at = pa.array(at, mask=(at < 0) | (group == missing))

        def of_past(column: str) -> pa.Array:
            lists = subject_rows[column].combine_chunks()
            return (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists).flatten().take(at)

        gaps = pa.StructArray.from_arrays(
            [
                pa.array(ids, pa.string()).take(pa.array(group - 1)), pa.array(descs, pa.string()).take(pa.array(name - 1)), pa.array(buyers),
                pa.array(cents, mask=valid == 0), of_past("past_sales"), of_past("past_date"), at.is_valid(),
            ],
            ["product_group_id", "product_group_desc", "buyers", "cents", "sales_ltd", "my_last_purchase", "bought"],
        )

        def lists(of: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=count))), pa.int32()), values)

        out = {"subject_id": subject_rows["customer_id"], "lookalikes": found, "gaps": lists(s, gaps)}
        if shown:
            if not heads:
                return
            ordered = pa.concat_tables(heads).sort_by([("s", "ascending"), ("place", "ascending")]).combine_chunks()
            columns = [c.chunk(0) for c in (ordered["who"], ordered["raw"], ordered["cents"])]
            out["first"] = lists(ordered["s"].to_numpy(), pa.StructArray.from_arrays(columns, ["who", "raw", "cents"]))
        yield pa.table(out).filter(pa.array(found > 0))

    return rows


def _told_gaps(comparison: _Comparison, pg12: DataFrame, ltd: DataFrame, min_pct: float, customer_dim: DataFrame | None = None) -> DataFrame:
    """(subject_id, first, gaps): gaps in order, the first GAP_ROWS, found while the peers pass; with a dimension their names, too."""
    names, named = _named(pg12)
    known = names.orderBy("name").toArrow()
    entry = F.struct("name", (F.col("sales_12m") * 100).cast("long").alias("cents"))
    mixes = named.groupBy("customer_id").agg(F.collect_list(entry).alias("mix"))
    mixes = stage(mixes.select("customer_id", F.col("mix.name").alias("bought"), F.col("mix.cents").alias("amounts")), "groups-bought")
    groups = names.where("product_group_id IS NOT NULL").groupBy("product_group_id").agg(F.min("name").alias("group"))
    entry = F.struct("group", "sales_ltd", "last_invoice_date")
    past = ltd.join(groups, "product_group_id").groupBy("customer_id").agg(F.collect_list(entry).alias("past"))
    own = mixes.select("customer_id", F.col("bought").alias("own")).join(past, "customer_id", "left").select(
        "customer_id", "own", F.col("past.group").alias("past_group"), F.col("past.sales_ltd").alias("past_sales"),
        F.col("past.last_invoice_date").alias("past_date"),
    )
    sales_ltd = ltd.schema["sales_ltd"].dataType.simpleString()
    schema = (
        "subject_id string, lookalikes long, gaps array<struct<product_group_id: string, product_group_desc: string, buyers: long, "
        f"cents: long, sales_ltd: {sales_ltd}, my_last_purchase: date, bought: boolean>>"
    )
    about, shown = mixes, 0
    if customer_dim is not None:
        called = customer_dim.groupBy("customer_id").agg(F.collect_list(F.struct("customer_name", "customer_class")).alias("who"))
        about, shown = mixes.join(called, "customer_id"), 8
        schema += ", first array<struct<who: array<struct<customer_name: string, customer_class: string>>, raw: double, cents: long>>"
    finish = _gap_lists(known["product_group_id"].to_pylist(), known["product_group_desc"].to_pylist(), float(min_pct), shown)
    told = comparison.told(finish, schema, about, own)

    def share(gap: Column) -> Column:
        return percent(gap["buyers"], F.col("lookalikes"))

    def row(gap: Column) -> Column:
        pct = F.round(share(gap), 1)
        average = F.round(F.try_divide(_dollars(gap["cents"], 38), gap["buyers"]), 0)
        shown_gap = F.struct(
            gap["product_group_id"].alias("product_group_id"),
            gap["product_group_desc"].alias("product_group_desc"),
            gap["buyers"].alias("lookalike_buyers"),
            F.col("lookalikes").alias("lookalikes"),
            pct.alias("penetration_pct"),
            average.alias("avg_sales_per_buyer"),
            F.round(F.coalesce(gap["sales_ltd"], F.lit(0).cast("decimal(28,2)")), 0).alias("my_lifetime_sales"),
            gap["my_last_purchase"].alias("my_last_purchase"),
            F.when(gap["bought"], K.BOUGHT_BEFORE).otherwise(K.NEVER_BOUGHT).alias("status"),
        )
        return F.struct((-pct).alias("o1"), (-average).alias("o2"), gap["product_group_id"].alias("o3"), shown_gap.alias("gap"))

    kept = F.filter("gaps", lambda gap: share(gap) >= F.lit(str(min_pct)).cast("decimal(12,4)"))
    ordered = F.slice(F.array_sort(F.transform(kept, row)), 1, K.GAP_ROWS)
    return told.withColumn("gaps", F.transform(ordered, lambda x: x["gap"]))


def lookalike_gap(
    pg12: DataFrame,
    ltd: DataFrame,
    subjects: DataFrame | None,
    n: int = K.LOOKALIKES,
    min_pct: float = K.GAP_MIN_PCT,
    customer_dim: DataFrame | None = None,
) -> DataFrame:
    """What each subject's look-alikes, customers of ``customer_dim``, buy that it did not buy in 12 months."""
    comparison = _Comparison(customer_vector(pg12), subjects, n, customer_dim)
    if comparison.whole:
        told = _told_gaps(comparison, pg12, ltd, min_pct)
        return told.select("subject_id", F.explode("gaps").alias("gap")).select("subject_id", "gap.*")
    return gaps_of_pairs(stage(_pairs(comparison).select("subject_id", "customer_id"), "peers"), pg12, ltd, min_pct)


def top_accounts(scope_customers: DataFrame, pg12: DataFrame, top: int) -> DataFrame:
    """The biggest accounts by 12-month sales in each scope.

    ``scope_customers`` is (scope_key, customer_id, customer_name).
    """
    totals = pg12.groupBy("customer_id").agg(F.sum("sales_12m").alias("exact"))
    sized = scope_customers.join(totals, "customer_id")
    best = top_rows(sized, ["scope_key"], [F.col("exact").desc_nulls_first(), F.col("customer_id").asc()], top)
    return best.select("scope_key", "customer_id", "customer_name", F.round("exact", 0).alias("sales_12m"))


def category_gaps(
    scope_customers: DataFrame,
    pg12: DataFrame,
    ltd: DataFrame,
    settings: Settings,
    top: int | None = None,
    min_pct: float | None = None,
    customer_dim: DataFrame | None = None,
) -> DataFrame:
    """The best gap of each of a scope's biggest accounts, and how many others it has.

    Works for any number of scopes at once; a shared account is compared once. Groups
    bought before come first, then the higher sales per buyer.
    """
    top = settings.required_int("gap_top_accounts") if top is None else top
    share = settings.get("gap_min_pct") if min_pct is None else min_pct
    accounts = stage(top_accounts(scope_customers, pg12, top), "top-accounts")
    if share is None:
        accounts = accounts.where(F.lit(False))
        share = 0
    gaps = lookalike_gap(pg12, ltd, accounts, K.LOOKALIKES, share, customer_dim)
    order = [
        F.col("status").startswith("bought before").desc(),
        F.col("avg_sales_per_buyer").desc_nulls_last(),
        F.col("product_group_id").asc(),
    ]
    first = top_rows(gaps, ["subject_id"], order, 1)
    counts = gaps.groupBy("subject_id").agg((F.count(F.lit(1)) - 1).alias("other_gaps"))
    return (
        accounts.join(first.join(counts, "subject_id").withColumnRenamed("subject_id", "customer_id"), "customer_id")
        .select(
            "scope_key", "customer_id", "customer_name", "sales_12m", "product_group_id", "product_group_desc",
            "penetration_pct", "avg_sales_per_buyer", "my_last_purchase", "status", "other_gaps",
        )
    )


def peer_gap(
    pg12: DataFrame,
    ltd: DataFrame,
    customer_dim: DataFrame,
    subjects: DataFrame,
    min_pct: float = K.GAP_MIN_PCT,
    n: int | None = None,
    show_sales: bool = True,
) -> DataFrame:
    """One row per subject: its first eight look-alikes and all its gaps as arrays.

    A subject without look-alikes keeps a row with a note.
    """
    n = clamp(n, K.LOOKALIKES, 5, 200)
    subjects = subjects.select("customer_id").distinct()
    comparison = _Comparison(customer_vector(pg12), subjects, n, customer_dim)
    keyed = subjects.withColumnRenamed("customer_id", "subject_id")
    if comparison.whole:
        found = _told_gaps(comparison, pg12, ltd, min_pct, customer_dim)

        def named(pair: Column) -> Column:
            raw, sales = pair["raw"], _dollars(pair["cents"])
            return F.transform(F.array_sort(pair["who"]), lambda who: _lookalike(who["customer_name"], who["customer_class"], raw, sales, show_sales))

        some = F.flatten(F.transform("first", named))
        found = found.select("subject_id", F.when(F.size(some) > 0, some).alias("ranked"), F.when(F.size("gaps") > 0, F.col("gaps")).alias("listed"))
    else:
        found = _gaps_of_few(comparison, pg12, ltd, customer_dim, min_pct, show_sales)
    note = "No lookalikes found: no sales in the last 12 months, so there is no purchase mix to compare."
    return keyed.join(found, "subject_id", "left").select(
        "subject_id", F.col("ranked").alias("top_lookalikes"), F.col("listed").alias("gaps"), F.when(F.col("ranked").isNull(), note).alias("note")
    )


def _lookalike(name: Column, class_: Column, raw: Column, sales: Column, show_sales: bool) -> Column:
    shown = F.round(sales, 0) if show_sales else F.lit(None).cast("decimal(28,0)")
    alike = F.floor(raw * 1000 + 0.5) / 1000
    return F.struct(name.alias("customer_name"), class_.alias("customer_class"), alike.alias("similarity"), shown.alias("sales_12m"))


def _gaps_of_few(
    comparison: _Comparison, pg12: DataFrame, ltd: DataFrame, customer_dim: DataFrame, min_pct: float, show_sales: bool
) -> DataFrame:
    """(subject_id, ranked, listed) by joins, for subjects whose peers are spread over tasks."""
    pairs = stage(_pairs(comparison), "peers")
    order = [similarity().desc(), F.col("customer_id").asc()]
    first = top_rows(pairs, ["subject_id"], order, 8, rank="rank")
    named = first.join(customer_dim.select("customer_id", "customer_name", "customer_class"), "customer_id")
    shown = _lookalike(F.col("customer_name"), F.col("customer_class"), F.col("raw"), F.col("sales_12m"), show_sales)
    best = named.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown")))).alias("ranked"))
    gaps = gaps_of_pairs(pairs, pg12, ltd, min_pct)
    columns = [c for c in gaps.columns if c != "subject_id"]
    listed = gaps.groupBy("subject_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("penetration_pct")).alias("o1"), (-F.col("avg_sales_per_buyer")).alias("o2"),
                    F.col("product_group_id").alias("o3"), F.struct(*columns).alias("gap"),
                )
            )
        ).alias("ordered")
    )
    return best.join(listed, "subject_id", "left").select(
        "subject_id", F.transform("ranked", lambda x: x["shown"]).alias("ranked"), F.transform("ordered", lambda x: x["gap"]).alias("listed")
    )


def class_gap(
    customer_dim: DataFrame,
    penetration: DataFrame,
    pg12: DataFrame,
    ltd: DataFrame,
    subjects: DataFrame | None,
    min_pct: float = K.GAP_MIN_PCT,
) -> DataFrame:
    """Groups the subject's market class buys and it did not; no class, no rows.

    The groups of a class are put in order once, as one list; each subject walks its
    class's list past the groups it bought and keeps the first TOOL_ROWS. Lists hold
    product groups only, so no table of customers x groups is built, shuffled or ranked.
    """
    me = restrict(customer_dim, subjects).where("customer_class IS NOT NULL")
    me = me.select(F.col("customer_id").alias("subject_id"), "customer_class")
    shown = ["product_group_id", "product_group_desc", "penetration_pct", "buyers_12m", "active_customers", "avg_sales_per_buyer"]
    asked = penetration.where(F.col("penetration_pct") >= F.lit(str(min_pct)).cast("decimal(12,4)"))
    entry = F.struct((-F.col("penetration_pct")).alias("o1"), F.col("product_group_id").alias("o2"), F.struct(*shown).alias("gap"))
    listed = asked.groupBy("customer_class").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["gap"]).alias("gaps"))
    # one row per class, staged so that its size is known before the join is planned
    listed = stage(listed, "class-lists")
    own = restrict(pg12, subjects).groupBy(F.col("customer_id").alias("subject_id")).agg(F.collect_set("product_group_id").alias("own"))
    known = F.struct("product_group_id", F.struct("sales_ltd", "last_invoice_date").alias("ltd"))
    before = (
        restrict(ltd, subjects).where("product_group_id IS NOT NULL")
        .groupBy(F.col("customer_id").alias("subject_id")).agg(F.map_from_entries(F.collect_list(known)).alias("before"))
    )
    missed = F.filter("gaps", lambda g: ~F.coalesce(F.array_contains(F.col("own"), g["product_group_id"]), F.lit(False)))
    found = (
        me.join(listed, "customer_class").join(own, "subject_id", "left").join(before, "subject_id", "left")
        .select("subject_id", "before", F.explode(F.slice(missed, 1, K.TOOL_ROWS)).alias("gap"))
        .select("subject_id", "gap.*", F.try_element_at("before", F.col("gap.product_group_id")).alias("past"))
    )
    return found.select(
        "subject_id", *shown,
        F.coalesce("past.sales_ltd", F.lit(0).cast("decimal(28,2)")).alias("my_lifetime_sales"),
        F.col("past.last_invoice_date").alias("my_last_purchase"),
        F.when(F.col("past").isNull(), K.NEVER_BOUGHT).otherwise(K.BOUGHT_BEFORE).alias("status"),
    )


def class_overview(penetration: DataFrame, classes: DataFrame, top: int | None = None) -> DataFrame:
    """Most common groups of the named market classes (case-insensitive).

    ``classes`` is (customer_class); the answer carries it as ``asked_class``.
    """
    top = clamp(top, 25, 1, 100)
    asked = classes.select(F.trim("customer_class").alias("asked_class")).distinct()
    found = penetration.join(asked, F.upper("customer_class") == F.upper("asked_class"))
    best = top_rows(
        found, ["asked_class"], [F.col("penetration_pct").desc_nulls_first(), F.col("product_group_id").asc()], top
    )
    return best.select(
        "asked_class", "product_group_id", "product_group_desc", "penetration_pct", "buyers_12m", "active_customers",
        "avg_sales_per_buyer", F.round("class_sales_12m", 0).alias("class_sales_12m"),
    )
