"""Tables that are kept up in place, against the same work on whole tables."""

import datetime
import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import make, rows, sales

from bookwise.operators import views
from bookwise.operators.monthly import MonthlyHistory, in_months, month_number
from bookwise.sources import sinks, tables as source
from bookwise.sources.keyed import KeyedTable
from bookwise.sources.parts import PartTable


def _folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-")


def _files(root):
    return set(glob.glob(f"{root}/**/*.parquet", recursive=True))


# --- keyed tables ----------------------------------------------------------------
def _big(spark, n=5000):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"), F.lit("old").alias("by"))


def test_ten_keys_rewrite_at_most_ten_files(spark):
    root, current = _folder("keyed"), _big(spark)
    table = KeyedTable.create(current, root, "t", ["k"], 64)
    before = _files(root)
    assert len(before) == 64
    changes = spark.createDataFrame([(f"k{i * 37}", i, s) for i in range(9) for s in (1, 2)] + [("new", 7, 1)], "k string, v int, seq int")
    order = [F.col("seq").desc()]
    touched = table.upsert(changes, order, {"by": F.lit("me")})
    assert len(touched) <= 10 and len(_files(root) - before) == len(touched)
    want = sinks.upsert(current, changes, ["k"], order, {"by": F.lit("me")})
    assert rows(table.read()) == rows(want)
    assert table.drop_unused() == len(touched) and len(_files(root)) == 64
    assert rows(KeyedTable(spark, root, "t").read()) == rows(want)


def test_keyed_tables_fold_keys_as_the_whole_upsert_does(spark):
    current = spark.createDataFrame([("a@x", 1), ("B@x ", 2), ("b@X", 3), (None, 4)], "k string, v int")
    changes = spark.createDataFrame([("A@x ", 5, 1), ("a@X", 6, 2), ("c@x", 7, 1), (None, 8, 1)], "k string, v int, seq int")
    table = KeyedTable.create(current, _folder("keyed"), "t", ["k"], 8, fold=True)
    table.upsert(changes, [F.col("seq").desc()], {})
    assert rows(table.read()) == rows(sinks.upsert(current, changes, ["k"], [F.col("seq").desc()], {}, fold=True))


def test_seeds_that_are_stored_rewrite_nothing(spark):
    root, current = _folder("keyed"), _big(spark, 300)
    table = KeyedTable.create(current, root, "t", ["k"], 16)
    before = _files(root)
    assert table.seed(current) == [] and _files(root) == before
    seeds = spark.createDataFrame([("k5", 9, "s"), ("x", 2, "s"), ("x", 1, "s")], "k string, v int, by string")
    assert len(table.seed(seeds)) == 1
    assert rows(table.read()) == rows(sinks.seed_if_absent(current, seeds, ["k"]))


def test_renames_keep_the_key_unique(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, v int")
    mapping = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", "d"), ("d", "y"), ("d", "x"), ("q", "w"), (None, "v"), ("a", None)], "old string, new string")
    table = KeyedTable.create(current, _folder("keyed"), "t", ["k"], 4)
    table.rename(mapping)
    assert rows(table.read()) == rows(sinks.key_remap(current, mapping, "k")) == [("b", 2), ("c", 3), ("x", 4), ("z", 1)]


def test_empty_tables_and_empty_changes(spark):
    empty = spark.createDataFrame([], "k string, v int, by string")
    table = KeyedTable.create(empty, _folder("keyed"), "t", ["k"], 4)
    assert rows(table.read()) == [] and table.seed(empty) == []
    assert table.upsert(empty.withColumn("seq", F.lit(1)), [F.col("seq")], {}) == []
    assert table.rename(spark.createDataFrame([], "old string, new string")) == []
    table.seed(_big(spark, 3))
    assert len(rows(table.read())) == 3


def test_readers_keep_their_state_and_writers_do_not_overrun(spark):
    root = _folder("parts")
    table = PartTable.create(_big(spark, 10), root, "t", F.col("v") % 2)
    before = table.read()
    other = PartTable(spark, root, "t")
    other.replace(_big(spark, 4).where("v % 2 = 0"), [0], F.col("v") % 2)
    assert before.count() == 10 and PartTable(spark, root, "t").read().count() == 7
    with pytest.raises(RuntimeError, match="another writer"):
        table.replace(_big(spark, 2).where("v % 2 = 1"), [1], F.col("v") % 2)
    with pytest.raises(ValueError, match="not replaced"):
        PartTable(spark, root, "t").replace(_big(spark, 4), [0], F.col("v") % 2)
    broken = _big(spark, 4).withColumn("by", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("by")))
    with pytest.raises(Exception, match="lost"):
        PartTable(spark, root, "t").replace(broken, [0, 1], F.col("v") % 2)
    assert PartTable(spark, root, "t").read().count() == 7


# --- monthly history ----------------------------------------------------------------
AS_OF = "2024-06-15"
LINES = [
    ("1", "2023-06-14", "g", 10), ("1", "2023-06-15", "g", 20), ("1", "2023-06-16", "h", 5), ("1", "2023-07-01", "g", 40),
    ("2", "2020-02-29", "g", 7), ("2", "2024-05-31", None, 3), ("3", "2022-01-01", "g", 1), (None, "2024-01-01", "g", 2), ("4", None, "g", 9),
]
LATER = [("1", "2024-06-10", "g", -15), ("5", "2024-06-11", "g", 50), ("3", "2022-01-20", "g", -1), ("6", "2025-01-01", "h", 1)]


def _same(history, lines, as_of=AS_OF):
    got, want = history.customer_pg(lines, as_of), views.customer_pg(lines, as_of)
    assert got.schema == want.schema
    assert rows(got) == rows(want)


@pytest.mark.parametrize("as_of", [AS_OF, "2024-06-01", "2024-06-30", "2021-02-28", "2030-01-01"])
def test_history_equals_the_full_build(spark, as_of):
    lines = sales(spark, *LINES, *LATER)
    charges = sales(spark, ("1", "2024-02-02", "g", 4), ("9", "2024-02-02", "f", 4)).withColumn("other_charge_item", F.lit("Y"))
    lines = lines.unionByName(charges)
    _same(MonthlyHistory.build(lines, _folder("monthly")), lines, as_of)


def test_appends_credits_and_deletions(spark):
    first, root = sales(spark, *LINES), _folder("monthly")
    history = MonthlyHistory.build(first, root)
    number = {d: int(d[:4]) * 12 + int(d[5:7]) for d in ("2022-01", "2024-05", "2024-06", "2025-01", "2020-02")}
    assert history.refresh(first) == [number["2024-05"]]
    grown = sales(spark, *LINES, *LATER)
    assert history.refresh(grown) == [number[m] for m in ("2022-01", "2024-05", "2024-06", "2025-01")]
    _same(history, grown)
    # a line that went, and one whose price changed in a month that is named
    shrunk = sales(spark, *[x for x in LINES if x[1] != "2020-02-29"], *LATER)
    shrunk = shrunk.withColumn("extended_price", F.when(F.col("invoice_date") == "2023-07-01", 41).otherwise(F.col("extended_price")).cast(shrunk.schema["extended_price"].dataType))
    assert number["2020-02"] in history.refresh(shrunk, also=[datetime.date(2023, 7, 9)])
    _same(history, shrunk)
    _same(MonthlyHistory(spark, root), shrunk)


def test_an_empty_history(spark):
    none = make(spark, "invoice_sales", [])
    history = MonthlyHistory.build(none, _folder("monthly"))
    _same(history, none)
    grown = sales(spark, *LINES)
    history.refresh(grown)
    _same(history, grown)


def test_a_refresh_reads_changed_months_alone(spark, tables):
    root = _folder("facts")
    source.replace_table(tables.invoice_sales, root, "invoice_sales", 4)
    facts = source.read_table(spark, root, "invoice_sales")
    history = MonthlyHistory.build(facts, root)
    newest = facts.agg(F.max(month_number("invoice_date"))).first()[0]
    assert history.changed_months(facts) == [newest]
    months = in_months(facts, [newest])
    read = {os.path.dirname(f) for f in months.select("invoice_no", F.input_file_name().alias("f")).select("f").distinct().toPandas()["f"]}
    assert len(read) == 1
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "fact_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    _same(history, facts, "2001-08-01")


# --- plans without a hot key or a product of customers and groups --------------------
def test_class_gap_ranks_no_table_of_customers_and_groups(spark, tables):
    from bookwise.operators import peers

    dim = views.customer_all(tables.customers, tables.salesreps)
    pg = views.customer_pg(tables.invoice_sales, "2001-08-01")
    found = peers.class_gap(dim, views.penetration_of(pg, dim), views.pg_12m(pg), views.pg_ltd(pg), None, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftAnti" not in plan and "Generate explode" in plan


def test_tasks_of_no_customer_stay_out_of_the_name_join(spark, tables):
    from bookwise.context import Scope

    tasks = views.task(tables.activity_trans, tables.task_outbox, views.erp_user(tables.erp_users),
                       views.customer_all(tables.customers, tables.salesreps), Scope("admin@example.com", "admin", None))
    plan = tasks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "isnull(" in plan
