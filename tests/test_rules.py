"""Literal micro-tables for the rules that are easy to get wrong."""

import datetime as dt
import math
import random
from decimal import Decimal as D

import numpy as np
import pyarrow as pa
import pytest
from helpers import customers, ids, make, only, rows, sales
from pyspark.sql import functions as F

from bookwise import constants as K
from bookwise.context import Scope, Settings, months_before
from bookwise.functions.staging import stage
from bookwise.operators import alike, customer, peers, triggers, views
from bookwise.sources import fixture, sinks

AS_OF = "2024-06-30"


def day(n):
    return (dt.date(2024, 6, 30) - dt.timedelta(days=n)).isoformat()


def test_other_charge_null_is_kept_and_y_is_left_out_of_rollups_only(spark):
    lines = sales(spark, ("1", day(5), "a", 10)).unionByName(
        make(spark, "invoice_sales", [
            {"customer_id": "1", "invoice_date": day(4), "product_group_id": "a", "extended_price": 20, "other_charge_item": None, "invoice_no": "x"},
            {"customer_id": "1", "invoice_date": day(3), "product_group_id": "a", "extended_price": 40, "other_charge_item": "Y", "invoice_no": "y"},
        ])
    )
    assert only(views.customer_pg_12m(lines, AS_OF))["sales_12m"] == D("30.00")
    dim = views.customer_all(customers(spark, ("1", None, "r")), make(spark, "salesreps", []))
    none = make(spark, "open_quotes", []), make(spark, "open_orders", [])
    found = only(customer.customer_snapshot(dim, lines, *none, views.customer_pg_12m(lines, AS_OF), None, AS_OF))
    assert found["sales_12m"] == 70 and found["invoices_12m"] == 3


def test_penetration_denominator_counts_charge_only_customers(spark):
    lines = sales(spark, ("1", day(5), "a", 10)).unionByName(sales(spark, ("2", day(5), "b", 10)).withColumn("other_charge_item", F.lit("Y")))
    found = only(views.class_pg_penetration(lines, customers(spark, ("1", "K", "r"), ("2", "K", "r")), AS_OF))
    assert (found["buyers_12m"], found["active_customers"], found["penetration_pct"]) == (1, 2, D("50.0"))


def test_penetration_needs_an_enabled_login(spark):
    args = sales(spark, ("1", day(5), "a", 10)), customers(spark, ("1", "K", "r")), AS_OF
    assert views.class_pg_penetration(*args, Scope()).count() == 0
    assert views.class_pg_penetration(*args, Scope("x", "rep", "9")).count() == 1


def test_windows_have_no_upper_bound(spark):
    lines = sales(spark, ("1", "2030-01-01", "a", 10))
    assert only(views.customer_pg_12m(lines, AS_OF))["sales_12m"] == 10


def test_month_end_clamps(spark):
    assert spark.range(1).select(months_before("2024-02-29", 12)).first()[0] == dt.date(2023, 2, 28)


def test_net_negative_group_leaves_the_vector_but_counts_as_bought(spark):
    lines = sales(
        spark, ("1", day(5), "a", 100), ("1", day(4), "a", -150), ("1", day(4), "b", 10),
        ("2", day(5), "a", 100), ("2", day(5), "b", 100),
    )
    pg12 = views.customer_pg_12m(lines, AS_OF)
    assert rows(views.customer_vector(pg12), "customer_id", "product_group_id") == [("1", "b"), ("2", "a"), ("2", "b")]
    gaps = peers.lookalike_gap(pg12, views.customer_pg_ltd(lines), ids(spark, "1"), 40, 10)
    assert gaps.count() == 0  # "a" nets to less than nothing, yet customer 1 bought it


def test_peer_sales_are_overlap_sales_and_hidden_from_reps(spark):
    lines = sales(spark, ("A", day(5), "g1", 10), ("A", day(5), "g2", 10), ("B", day(5), "g1", 30), ("B", day(5), "g3", 30))
    dim = views.customer_all(customers(spark, ("A", None, "r"), ("B", None, "r")), make(spark, "salesreps", []))
    pg12 = views.customer_pg_12m(lines, AS_OF)
    found = only(peers.lookalikes(pg12, dim, ids(spark, "A")))
    assert (found["customer_id"], found["similarity"], found["sales_12m"]) == ("B", 0.5, D("30"))
    assert only(peers.lookalikes(pg12, dim, ids(spark, "A"), show_sales=False))["sales_12m"] is None


def test_threshold_is_on_the_unrounded_similarity(spark):
    # cosine 0.2996...: shown as 0.3, but below the threshold
    lines = sales(spark, ("A", day(5), "g1", 100), ("B", day(5), "g1", "29.96"), ("B", day(5), "g2", "95.41"))
    vectors = views.customer_vector(views.customer_pg_12m(lines, AS_OF))
    w = {r["product_group_id"]: r["w"] for r in vectors.where("customer_id = 'B'").collect()}
    assert round(w["g1"], 3) == 0.3 and w["g1"] < 0.3
    assert peers.similar_pairs(vectors, ids(spark, "A")).count() == 0
    assert peers.similar_pairs(vectors, None).count() == 0


def test_null_group_of_a_peer_is_a_gap_never_bought(spark):
    lines = sales(spark, ("A", day(5), "g1", 10), ("A", day(5), None, 5), ("B", day(5), "g1", 10), ("B", day(5), None, 5))
    gaps = peers.lookalike_gap(views.customer_pg_12m(lines, AS_OF), views.customer_pg_ltd(lines), ids(spark, "A"), 40, 10)
    found = only(gaps)
    assert found["product_group_id"] is None and found["status"] == K.NEVER_BOUGHT


def test_gap_denominator_is_the_lookalikes_found(spark):
    lines = sales(
        spark, ("A", day(5), "g", 10), ("B", day(5), "g", 10), ("C", day(5), "g", 10), ("B", day(5), "h", 1),
        ("A", "2020-01-01", "h", 7),
    )
    found = only(peers.lookalike_gap(views.customer_pg_12m(lines, AS_OF), views.customer_pg_ltd(lines), ids(spark, "A"), 40, 10))
    assert (found["lookalikes"], found["penetration_pct"], found["status"]) == (2, D("50.0"), K.BOUGHT_BEFORE)
    assert found["my_lifetime_sales"] == 7 and found["my_last_purchase"] == dt.date(2020, 1, 1)


def test_category_gaps_prefer_recapture_over_value(spark):
    lines = sales(
        spark, ("A", day(5), "g", 1000), ("B", day(5), "g", 10), ("B", day(5), "dear", 5), ("B", day(5), "cheap", 1),
        ("A", "2020-01-01", "cheap", 1),
    )
    scopes = spark.createDataFrame([("*", "A", "NA")], "scope_key string, customer_id string, customer_name string")
    args = scopes, views.customer_pg_12m(lines, AS_OF), views.customer_pg_ltd(lines)
    found = only(peers.category_gaps(*args, Settings(), None, 10))
    assert (found["product_group_id"], found["other_gaps"]) == ("cheap", 1)
    with pytest.raises(ValueError):
        peers.category_gaps(*args, Settings().replace(gap_top_accounts=None))
    assert peers.category_gaps(*args, Settings().replace(gap_min_pct=None)).count() == 0


def test_distinct_arrays_null_rules(spark):
    quotes = make(spark, "open_quotes", [
        {"customer_id": "1", "order_no": "o1", "order_date": day(10), "extended_price": 3000, "product_group_desc": g} for g in ("b", None, "a")
    ] + [{"customer_id": "1", "order_no": "o2", "order_date": day(10), "extended_price": 3000}])
    kept = rows(customer.open_quotes(quotes, None, None, AS_OF), "order_no", "product_groups")
    assert kept == [("o1", ["a", "b", None]), ("o2", [None])]
    dropped = rows(triggers.stale_quotes(quotes, Settings(), AS_OF), "order_no", "product_groups")
    assert dropped == [("o1", ["a", "b"]), ("o2", None)]


def test_top_items_put_null_prices_first(spark):
    prices = [(5, "five"), (None, "none"), (9, "nine"), (1, "one"), (7, "seven")]
    lines = make(spark, "invoice_sales", [
        {"customer_id": "1", "invoice_no": "i", "invoice_date": day(3), "extended_price": p, "item_desc": d} for p, d in prices
    ])
    assert only(customer.recent_activity(lines, None, None, AS_OF))["top_items"] == ["none", "nine", "seven", "five"]


def test_snapshot_without_groups_has_null_not_empty(spark):
    dim = views.customer_all(customers(spark, ("1", None, None)), make(spark, "salesreps", []))
    lines = sales(spark, ("2", day(5), "a", 1))
    found = only(customer.customer_snapshot(
        dim, lines, make(spark, "open_quotes", []), make(spark, "open_orders", []), views.customer_pg_12m(lines, AS_OF), None, AS_OF
    ))
    assert found["top_groups"] is None and found["sales_lifetime"] is None and found["open_orders"] == 0


def test_one_invoice_day_has_no_median_and_uses_the_floor(spark):
    settings = Settings().replace(quiet_min_invoices_12m=1)
    assert triggers.going_quiet(sales(spark, ("1", day(21), "a", 1)), settings, AS_OF).count() == 1
    assert triggers.going_quiet(sales(spark, ("1", day(20), "a", 1)), settings, AS_OF).count() == 0
    # the upper bound of a reorder is NULL without a median: no row
    settings = Settings().replace(reorder_min_orders=1, reorder_min_value_12m=0)
    assert triggers.reorder_due(sales(spark, ("1", day(30), "a", 1)), settings, AS_OF).count() == 0


def test_median_interpolates_and_rounds_half_up(spark):
    lines = sales(spark, ("1", day(65), "a", 1), ("1", day(55), "a", 1), ("1", day(40), "a", 1))
    found = only(triggers.going_quiet(lines, Settings().replace(quiet_min_invoices_12m=3), AS_OF))
    assert found["usual_gap_days"] == 13 and found["days_silent"] == 40


def test_cadence_counts_days_not_invoices(spark):
    lines = sales(spark, *[("1", day(30), g, 1) for g in "abc"])
    settings = Settings().replace(quiet_min_invoices_12m=2)
    assert triggers.going_quiet(lines, settings, AS_OF).count() == 0


def test_two_names_on_one_day_are_one_day(spark):
    lines = sales(spark, ("1", day(60), "a", 1), ("1", day(40), "a", 1), ("1", day(40), "a", 1))
    renamed = lines.withColumn("customer_name", F.when(F.col("invoice_date") == day(60), "Z").otherwise(F.concat(F.lit("N"), F.monotonically_increasing_id())))
    found = only(triggers.going_quiet(renamed, Settings().replace(quiet_min_invoices_12m=2), AS_OF))
    assert (found["invoice_days_12m"], found["usual_gap_days"], found["customer_name"]) == (2, 20, "Z")


def test_missing_setting_gives_no_rows(spark):
    quotes = make(spark, "open_quotes", [{"customer_id": "1", "order_no": "o", "order_date": day(10), "extended_price": 9000}])
    assert triggers.stale_quotes(quotes, Settings(), AS_OF).count() == 1
    assert triggers.stale_quotes(quotes, Settings().replace(quote_min_value=None), AS_OF).count() == 0
    assert triggers.stale_quotes(quotes, Settings().replace(quote_max_age_days=None), AS_OF).count() == 0


def test_quote_band_filters_lines_before_grouping(spark):
    quotes = make(spark, "open_quotes", [
        {"customer_id": "1", "order_no": "o", "order_date": day(n), "extended_price": 2000} for n in (7, 90, 91)
    ])
    found = only(triggers.stale_quotes(quotes, Settings(), AS_OF))
    assert (found["quote_value"], found["lines"], found["age_days"]) == (4000, 2, 90)


def test_new_account_totals_include_charges_and_skip_old_accounts(spark):
    lines = sales(spark, ("1", day(10), "a", 5), ("1", day(45), None, 5), ("2", day(46), "a", 5), ("2", day(1), "a", 5))
    lines = lines.withColumn("other_charge_item", F.lit("Y"))
    found = only(triggers.new_accounts(lines, Settings(), AS_OF))
    assert (found["customer_id"], found["sales_to_date"], found["invoices"], found["product_groups"]) == ("1", 10, 2, ["G a"])


def test_settings_load_keeps_known_keys(spark):
    table = make(spark, "list_settings", [{"key": "gap_min_pct", "value": 30}, {"key": "other", "value": 1}])
    loaded = Settings.load(table)
    assert loaded.get("gap_min_pct") == 30 and loaded.get("quote_min_value") is None


def test_rounding_in_views_and_in_the_export(spark):
    df = spark.sql("SELECT CAST(0.125 AS DECIMAL(10,3)) AS a, CAST(2.5 AS DECIMAL(10,1)) AS b, CAST(NULL AS STRING) AS c, DATE '2024-01-02' AS d")
    assert sinks.json_rows(df).first()[0] == '{"a":0.12,"b":2.5,"c":null,"d":"2024-01-02"}'
    assert df.select(F.round("b", 0)).first()[0] == 3


def test_json_export_caps_rows(spark):
    assert sinks.json_rows(spark.range(500).toDF("n"), 200).count() == 200


def test_compacted_sales_give_the_same_rollups_and_cadence(spark, tables):
    lines = tables.invoice_sales
    compact = views.daily_sales(lines)
    as_of = "2001-08-01"
    assert rows(views.customer_pg_12m(lines, as_of)) == rows(views.customer_pg_12m(compact, as_of))
    assert rows(views.pg_ltd(views.customer_pg(compact, as_of))) == rows(views.customer_pg_ltd(lines))
    assert rows(triggers.going_quiet(lines, Settings(), as_of)) == rows(triggers.going_quiet(compact, Settings(), as_of))
    want = rows(views.class_pg_penetration(lines, tables.customers, as_of))
    assert rows(views.class_pg_penetration(compact, tables.customers, as_of)) == want
    assert rows(views.penetration_of(views.customer_pg(lines, as_of), tables.customers)) == want
    assert rows(views.pg_12m(views.customer_pg(lines, as_of))) == rows(views.customer_pg_12m(lines, as_of))


def test_peers_without_a_dimension_row_do_not_count(spark):
    lines = sales(spark, *[(c, "2024-05-01", "g", "10") for c in ("A", "B", "C", "D")])
    pg12, dim = views.customer_pg_12m(lines, AS_OF), customers(spark, ("A", "K", "1"), ("C", "K", "1"), ("D", "K", "1"))
    full = views.customer_all(dim, make(spark, "salesreps", []))
    found = peers.lookalikes(pg12, full, ids(spark, "A"), 2)
    assert rows(found, "customer_id") == [("C",), ("D",)]
    gap = peers.similar_pairs(views.customer_vector(pg12), ids(spark, "A"), 2, dim)
    assert rows(gap, "customer_id") == [("C",), ("D",)]


def test_similarity_does_not_depend_on_the_other_subjects(spark, tables):
    pg12 = views.customer_pg_12m(tables.invoice_sales, fixture.AS_OF)
    vectors = stage(views.customer_vector(pg12), "vectors")
    everybody = [r[0] for r in vectors.select("customer_id").distinct().orderBy("customer_id").collect()]
    whole = {tuple(r) for r in peers.similar_pairs(vectors, None, 10).collect()}
    for n in (1, 64, 65):
        few = set(everybody[:n])
        found = {tuple(r) for r in peers.similar_pairs(vectors, ids(spark, *few), 10).collect()}
        assert found == {r for r in whole if r[0] in few}


def sparse_sales(seed, customers_, groups, bought):
    """Random baskets: a group that everybody buys, some common ones and many rare ones."""
    rng = random.Random(seed)
    lines = []
    for c in range(customers_):
        for g in {0, *(int(groups * rng.random() ** 2) for _ in range(rng.randrange(bought)))}:
            lines.append((f"c{c:04d}", f"g{g:03d}", D(rng.randrange(1, 500)) if g else D(rng.randrange(1, 30))))
    return lines


def brute_pairs(lines, subjects, n):
    mixes = {}
    for c, g, x in lines:
        mixes.setdefault(c, {})[g] = x
    weights = {c: {g: round(float(x) / float(sum(v * v for v in m.values())) ** 0.5 * 2**26) for g, x in m.items()} for c, m in mixes.items()}
    out = set()
    for a in subjects:
        found = []
        for b in mixes:
            raw = sum(w * weights[b].get(g, 0) for g, w in weights[a].items()) / 2.0**52
            if a != b and raw >= K.MIN_SIMILARITY:
                found.append((-math.floor(raw * 1000 + 0.5), b, raw, sum(x for g, x in mixes[b].items() if g in mixes[a])))
        out |= {(a, b, raw, x) for _, b, raw, x in sorted(found)[:n]}
    return out


@pytest.mark.parametrize("block, cells, groups, bought", [(4096, 1 << 20, 60, 12), (40, 500, 60, 12), (64, 1 << 20, 400, 25)])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, block, cells, groups, bought):
    monkeypatch.setattr(peers, "BLOCK", block)
    monkeypatch.setattr(peers, "_CELLS", cells)
    lines = sparse_sales(block, 250, groups, bought)
    vectors = views.customer_vector(spark.createDataFrame(lines, "customer_id string, product_group_id string, sales_12m decimal(18,2)"))
    everybody = sorted({c for c, _, _ in lines})
    ours = {(r[0], r[1], r[2], r[3]) for r in peers.similar_pairs(vectors, None, 7).collect()}
    assert ours == brute_pairs(lines, everybody, 7)
    few = {(r[0], r[1], r[2], r[3]) for r in peers.similar_pairs(vectors, ids(spark, *everybody[::40]), 7).collect()}
    assert few == {r for r in ours if r[0] in everybody[::40]}


def test_prefixes_leave_out_most_pairs_and_no_similar_one(spark):
    lines = sparse_sales(1, 400, 900, 30)
    vectors = views.customer_vector(spark.createDataFrame(lines, "customer_id string, product_group_id string, sales_12m decimal(18,2)"))
    leads = {r["customer_id"]: set(r["leads"]) for r in peers.packed_vectors(vectors).collect()}
    meet = {(a, b) for a in leads for b in leads if a < b and leads[a] & leads[b]}
    similar = {(a, b) for a, b, _, _ in brute_pairs(lines, sorted(leads), 400) if a < b}
    every = len(leads) * (len(leads) - 1) // 2
    # everybody buys one group, so every pair shares something
    assert similar <= meet and 0 < len(similar) and len(meet) < 0.7 * every


def test_a_list_is_many_tasks_and_a_subject_keeps_n_rows_in_each(spark, monkeypatch):
    monkeypatch.setattr(peers, "BLOCK", 50)
    lines = [(f"c{i:04d}", "g", D(5)) for i in range(400)]
    vectors = views.customer_vector(spark.createDataFrame(lines, "customer_id string, product_group_id string, sales_12m decimal(18,2)"))
    mixes = pa.table({"lead": [1] * 60, "customer_id": [f"c{i:04d}" for i in range(60)], "places": [[1]] * 60, "w": [[float(1 << 26)]] * 60, "cents": [[500]] * 60})
    assert peers._compare_block(mixes, mixes, 4).num_rows == 60 * 4
    assert peers.similar_pairs(vectors, None, 4).groupBy("subject_id").count().where("count <> 4").isEmpty()
    assert peers.similar_pairs(vectors, None, 4).where("subject_id = 'c0399'").select("customer_id").orderBy("customer_id").first()[0] == "c0000"


@pytest.mark.parametrize("groups, bought", [(12, 6), (200, 12)])
def test_peers_pass_whole_blocks_of_subjects_and_no_pair_is_shuffled(spark, monkeypatch, groups, bought):
    for name, value in {"BLOCK": 16, "BLOCKS": 3, "SUBJECTS": 40, "_PEERS": (8, 32), "_RUN": 8, "_CELLS": 300}.items():
        monkeypatch.setattr(peers, name, value)
    lines = sparse_sales(groups, 300, groups, bought)
    lines += [(f"{c}-copy", g, x) for c, g, x in lines[:300]]
    vectors = views.customer_vector(spark.createDataFrame(lines, "customer_id string, product_group_id string, sales_12m decimal(18,2)"))
    found = peers.similar_pairs(vectors, None, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(subject_id" not in plan and "Window [" not in plan and plan.count("Exchange") == 1, plan
    assert {(r[0], r[1], r[2], r[3]) for r in found.collect()} == brute_pairs(lines, sorted({c for c, _, _ in lines}), 5)


def test_lookalikes_of_everybody_join_and_shuffle_no_pair(spark, monkeypatch):
    for name, value in {"BLOCK": 16, "BLOCKS": 3, "SUBJECTS": 40}.items():
        monkeypatch.setattr(peers, name, value)
    lines = sparse_sales(5, 150, 70, 9)
    pg12 = spark.createDataFrame(lines, "customer_id string, product_group_id string, sales_12m decimal(18,2)")
    everybody = sorted({c for c, _, _ in lines})
    dim = views.customer_all(customers(spark, *[(c, f"K{c}", "1") for c in everybody]), make(spark, "salesreps", []))
    found = peers.lookalikes(pg12, dim, None, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1, plan
    want = {(a, b, f"N{b}", f"K{b}", math.floor(raw * 1000 + 0.5) / 1000, round(x)) for a, b, raw, x in brute_pairs(lines, everybody, 6)}
    assert {(*r[:5], int(r[5])) for r in found.collect()} == want


def test_most_peers_are_left_out_by_leaf_and_twig(monkeypatch):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        mix = {g: rng.random() for g in rng.sample(range(1, 9), 2)}
        norm = sum(v * v for v in mix.values()) ** 0.5
        rows.append({"customer_id": f"c{i:04d}", "rank": i, "peer": True, "places": sorted(mix), "w": [round(mix[g] / norm * 2**26) for g in sorted(mix)]})
    rows.sort(key=lambda r: sorted(zip(r["w"], r["places"]), reverse=True)[0][1])
    table = pa.Table.from_pylist(rows)
    table = table.take(pa.array(alike.arrange(table, 8)))
    seen, compare = [], alike.Best._compare
    monkeypatch.setattr(alike.Best, "_compare", lambda self, run, *args: seen.append(len(args[-1]) * self.runs.sizes[run]) or compare(self, run, *args))
    pairs = alike.best_peers(table, [table], 10, (512, 1 << 17), 1 << 20).pairs()
    dense = np.zeros((3000, 9))
    for r in table.to_pylist():
        dense[r["rank"], r["places"]] = r["w"]
    raw = dense @ dense.T / 2.0**52
    key = np.where(raw >= K.MIN_SIMILARITY, np.floor(raw * 1000 + 0.5) * 10_000 - np.arange(3000), -1)
    np.fill_diagonal(key, -1)
    best = np.argsort(-key, axis=1)[:, :10]
    want = {(a, int(b)) for a in range(3000) for b in best[a] if key[a, b] >= 0}
    assert set(zip(table["rank"].to_numpy()[pairs.s].tolist(), pairs.rank.tolist())) == want
    assert sum(seen) < 0.3 * 3000 * 3000


def test_gaps_of_everybody_join_no_pair_and_equal_those_of_few(spark, monkeypatch):
    rng = random.Random(3)
    lines, earlier = [], []
    for c in range(150):
        for g in rng.sample(["a", "b", "c", "d", "e", "f", "g", "h", None], rng.randrange(1, 7)):
            lines.append((f"c{c:03d}", f"2024-0{rng.randrange(1, 6)}-01", g, None if g == "h" else rng.choice([None, -5, *range(1, 90)])))
        earlier += [(f"c{c:03d}", "2020-01-01", g, rng.randrange(9, 99)) for g in rng.sample(["a", "b", "c", "z", None], 2)]
    recent = sales(spark, *lines).withColumn("product_group_desc", F.expr("CASE WHEN extended_price > 60 THEN 'Z' WHEN extended_price > 9 THEN product_group_desc END"))
    pg12 = stage(views.customer_pg_12m(recent, AS_OF), "pg12")
    ltd = stage(views.customer_pg_ltd(recent.unionByName(sales(spark, *earlier))), "ltd")
    dim = views.customer_all(customers(spark, *[(f"c{c:03d}", "K", "1") for c in range(140)]), make(spark, "salesreps", []))
    everybody = pg12.select("customer_id")

    def found():
        return peers.lookalike_gap(pg12, ltd, None, 9, 20, dim), peers.peer_gap(pg12, ltd, dim, everybody, 20, 9)

    want = [rows(df) for df in found()]
    for name, value in {"BLOCK": 16, "BLOCKS": 3, "SUBJECTS": 40}.items():
        monkeypatch.setattr(peers, name, value)
    gaps, listed = found()
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1, plan
    assert [rows(gaps), rows(listed)] == want
    assert gaps.schema.simpleString() == peers.lookalike_gap(pg12, ltd, ids(spark, "c001"), 9, 20, dim).schema.simpleString()
    assert any(r["avg_sales_per_buyer"] is None for r in gaps.collect()) and any(r["product_group_id"] is None for r in gaps.collect())


def test_gaps_carry_a_peers_groups_as_one_row_and_sort_no_bought_row(spark):
    lines = sales(spark, *[("A", day(5), "g", 10), ("B", day(5), "g", 10), ("B", day(5), "h", 4), ("C", day(5), "g", 10), ("C", day(5), "h", 2)])
    lines = lines.withColumn("product_group_desc", F.expr("CASE WHEN customer_id = 'C' THEN 'Z ' || product_group_id WHEN product_group_id = 'g' THEN product_group_desc END"))
    pg12 = stage(views.customer_pg_12m(lines, AS_OF), "pg12")
    pairs = stage(peers.similar_pairs(views.customer_vector(pg12), ids(spark, "A"), 40), "pairs")
    found = peers.gaps_of_pairs(pairs, pg12, stage(views.customer_pg_ltd(lines), "ltd"), 10)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "product_group_id", "product_group_desc", "lookalike_buyers", "avg_sales_per_buyer") == [("h", "Z h", 2, D(3))]


def test_lines_are_not_dealt_out_by_customer(spark, tables):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        names = tables.invoice_sales.select("customer_name", "product_group_id", "extended_price")
        plan = names._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_customer = [i for i, line in enumerate(plan) if "hashpartitioning(o_custkey" in line]
    assert by_customer and not [i for i in by_customer if "l_partkey" in plan[i + 1]]


def test_vocabulary_lists_every_common_group(spark):
    groups = [f"g{i:03d}" for i in range(230)]
    lines = sales(spark, *[("1", "2024-05-01", g, "10") for g in groups])
    pg12, dim = views.customer_pg_12m(lines, AS_OF), customers(spark, ("1", "K", "1"))
    pen = views.class_pg_penetration(lines, dim, AS_OF, Scope("a", "admin", None))
    listed = customer.vocabulary(dim, pg12, pen).where("list = 'products'").first()["words"]
    assert len(listed.split(", ")) == 230
