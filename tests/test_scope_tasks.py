"""Scoping, tasks, checks, free-form statements and sinks."""

import datetime as dt
import json
import os
import random
import tempfile
import time
from functools import partial

import pytest
from conftest import SF_DIR
from helpers import customers, ids, make, only, rows
from pyspark.sql import functions as F

from bookwise import constants as K, schemas
from bookwise.context import Scope, normalise_login
from bookwise.operators import guard, scope, tasks, validate, views
from bookwise.operators.weeklist import WeekList, compact, money
from bookwise.context import Settings
from bookwise.sources import fixture, sinks, tables as source
from bookwise.streaming import outbox as stream
from bookwise.workbench import Workbench

AS_OF = fixture.AS_OF


@pytest.fixture(scope="module")
def bench_of(spark):
    made = {}

    def get(login):
        if login not in made:
            made[login] = Workbench(spark, partial(fixture.tables, sf_dir=SF_DIR), login, AS_OF)
        return made[login]

    return get


# --- scope ---------------------------------------------------------------------
@pytest.mark.parametrize("raw,want", [("DDoe@Example.com", "ddoe@example.com"), ("  A@B.co ", "a@b.co"), (None, ""), ("", "")])
def test_normalise_login(raw, want):
    assert normalise_login(raw) == want


@pytest.mark.parametrize("login", ["", None, "nobody@example.com", "off@example.org"])
def test_scope_fails_closed(bench_of, login):
    b = bench_of(login)
    for view in (b.customer_dim, b.sales_line, b.open_quote_line, b.class_pg_penetration, b.salesrep, b.task):
        assert view.isEmpty()
    assert b.lookalikes().isEmpty() and b.find_customer(b.t.customers.select(F.col("customer_id").alias("query"))).isEmpty()


def test_login_is_case_insensitive(bench_of):
    assert bench_of(" ADMIN@Example.com ").scope.sees_all


def test_rep_sees_own_book_and_null_reps_belong_to_nobody(spark, bench_of):
    mine = bench_of("rep3@example.com").customer_dim
    assert {r[0] for r in mine.select("salesrep_id").distinct().collect()} == {"3"}
    whole = bench_of("admin@example.com").customer_dim
    assert whole.where("salesrep_id IS NULL").count() > 0
    assert not scope.scope_customer(customers(spark, ("1", None, None)), Scope("x", "rep", "3")).count()


def test_other_reps_account_is_empty_through_each_tool(spark, bench_of):
    b = bench_of("rep3@example.com")
    other = b.t.customers.where("salesrep_id = '5'").select("customer_id")
    for df in (
        b.customer_snapshot(other), b.recent_activity(other, 60), b.open_quotes(other, 3650), b.cancelled_quotes(other, 60),
        b.class_gap(other), b.peer_gap(other), b.lookalike_gap(other), b.lookalikes(other),
    ):
        assert df.isEmpty()


def test_unknown_id_is_empty(spark, bench_of):
    b, unknown = bench_of("admin@example.com"), ids(spark, "999999999")
    for df in (b.customer_snapshot(unknown), b.recent_activity(unknown), b.open_quotes(unknown), b.class_gap(unknown), b.peer_gap(unknown)):
        assert df.isEmpty()


def test_lookalikes_are_the_whole_population_without_sales_for_a_rep(bench_of):
    found = bench_of("rep3@example.com").lookalikes()
    assert found.where("sales_12m IS NOT NULL").isEmpty()
    assert found.where("customer_id = subject_id OR similarity < 0.3 OR similarity > 1").isEmpty()
    own = {r[0] for r in bench_of("rep3@example.com").customer_dim.select("customer_id").collect()}
    assert {r["customer_id"] for r in found.collect()} - own
    assert not bench_of("admin@example.com").lookalikes().where("sales_12m IS NULL").count()


def test_rep_lookalikes_equal_the_managers_for_the_same_subjects(bench_of):
    b = bench_of("rep3@example.com")
    subjects = b.customer_dim.select("customer_id")
    want = rows(bench_of("manager@example.com").lookalikes(subjects), "subject_id", "customer_id", "similarity")
    assert rows(b.lookalikes(), "subject_id", "customer_id", "similarity") == want


def test_only_admins_read_the_rep_list(bench_of):
    assert bench_of("manager@example.com").salesrep.isEmpty()
    assert bench_of("admin@example.com").salesrep.count() == 25


# --- statements ---------------------------------------------------------------------
ACCEPTED = [
    "SELECT max(sales_12m) FROM book.customer_pg_12m",
    "\t\nselect city, count(*) from book.customer group by city having count(*) > 3",
    "WITH top AS (SELECT customer_id FROM book.customer_vector WHERE w > 0.5), names AS (SELECT * FROM book.customer) SELECT * FROM top JOIN names USING (customer_id)",
    "With Mixed AS (SELECT 2 AS n) SELECT n FROM mixed",
    "SELECT product_group_id AS dropped, 1 AS calls, updated FROM book.sales_line",  # words that only contain a forbidden one
    "SELECT * FROM book.task, nowhere",  # comma joins are left to the second barrier
]
REFUSED = [
    ("", "empty"), (" \n ", "empty"), (None, "empty"),
    ("SELECT 7; SELECT 8", "semicolon"), ("SELECT 'a;b'", "semicolon"),
    ("VALUES (1)", "SELECT or WITH"), ("(SELECT 1)", "SELECT or WITH"), ("selector", "SELECT or WITH"),
    ("SELECT 1 -- why", "comments"), ("SELECT 1 /* why */", "comments"),
    ("SELECT * FROM customers", "not allowed"), ("SELECT * FROM other.customer", "not allowed"),
    ("SELECT * FROM book.customer LEFT JOIN invoices ON true", "not allowed"),
    ("SELECT * FROM book.customer EXCEPT SELECT * FROM bookkeeping.customer", "not allowed"),
    ("WITH own AS (SELECT 1) SELECT * FROM own JOIN foreign_one ON true", "not allowed"),
    ("SELECT extract(DAY FROM due_date) FROM book.task", "not allowed"),
    *[(f"SELECT {word.upper()} FROM book.customer", "forbidden") for word in K.FORBIDDEN_WORDS],
    *[(f"SELECT x FROM book.customer WHERE {prefix}abc(1) > 2", "forbidden") for prefix in K.FORBIDDEN_PREFIXES],
]


def test_statement_check(spark):
    texts = [(s, None) for s in ACCEPTED] + REFUSED
    df = validate.statement_check(spark.createDataFrame(texts, "sql string, want string"))
    for row in df.collect():
        if row["want"] is None:
            assert row["reason"] is None, row
        else:
            assert row["reason"] and row["want"].lower() in row["reason"].lower(), row


def test_guarded_select_caps_and_scopes(bench_of):
    b = bench_of("rep3@example.com")
    assert b.run_select("SELECT count(*) AS n FROM book.customer;").first()["n"] == b.customer_dim.count()
    b = bench_of("admin@example.com")
    assert b.run_select("SELECT invoice_no FROM book.sales_line ORDER BY invoice_no").count() == K.SELECT_ROWS
    assert b.run_select("SELECT 'book.customer' AS x, customer_id FROM book.customer LIMIT 3").first()["x"] == "book.customer"


@pytest.mark.parametrize("sql,part", [
    ("SELECT no_such_column FROM book.customer", "no_such_column"),
    ("SELECT * FROM book.customer_all", "customer_all"),
    ("SELECT * FROM book.task LIMIT 3 OFFSET 1", "LIMIT"),
    ("SELECT 1/0 FROM book.customer", "zero"),
    ("SELECT CAST(customer_name AS DATE) FROM book.customer", "CAST"),
    ("SELECT * FROM book.customer, parquet.`/root/testdata/sf0.001/customer.parquet`", "not allowed"),
    ("SELECT * FROM book.customer, global_temp.secrets", "not allowed"),
    ("SELECT (SELECT max(x) FROM `default`.`t`) FROM book.customer", "not allowed"),
    ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "forbidden"),
    ("SELECT TRANSFORM(customer_id) USING 'cat' AS (x) FROM book.customer", "not allowed"),
    ("DROP TABLE book.customer", "SELECT or WITH"),
])
def test_guarded_select_errors_are_data(bench_of, sql, part):
    found = bench_of("admin@example.com").run_select(sql)
    assert found.columns == ["error"] and part.lower() in only(found)["error"].lower()


def test_isolated_session_hides_the_parents_views(spark, bench_of):
    spark.range(1).createOrReplaceTempView("parent_secret")
    assert "error" in bench_of("admin@example.com").run_select("SELECT * FROM book.parent_secret").columns


# --- tasks ---------------------------------------------------------------------------
def test_null_completed_flag_is_not_open(spark, bench_of):
    b = bench_of("admin@example.com")
    assert b.task.where("completed IS NULL").count() > 0
    assert b.task_feed(True).where("completed IS NULL OR completed").isEmpty()


def test_task_visibility(bench_of):
    def seen(login):
        return {r[0] for r in bench_of(login).task.where("source = 'outbox'").select("outbox_id").collect()}

    assert seen("rep3@example.com") == {"ob-0", "ob-1", "ob-2"}
    assert seen("rep5@example.com") == {"ob-0", "ob-4"}
    assert seen("admin@example.com") == {"ob-0", "ob-1", "ob-2", "ob-4"}
    mine = bench_of("rep3@example.com").task.where("source = 'erp'")
    assert mine.where("assigned_to_erp <> 'R3' AND assigned_by_erp <> 'R3'").isEmpty()
    # outside the book: the id shows, the name does not
    own = bench_of("rep3@example.com").customer_dim.select("customer_id")
    assert mine.join(own, "customer_id", "left_anti").where("customer_name IS NOT NULL").isEmpty()


def test_a_rep_cannot_ask_for_everyones_tasks(bench_of):
    found = bench_of("rep3@example.com").task_feed(everyone=True)
    assert {r[0] for r in found.select("assigned_to_login").distinct().collect()} == {"rep3@example.com"}


CREATE = "session_login string, created_by string, assigned_to string, customer_id string, subject string, due_date string"


@pytest.mark.parametrize("change,reasons", [
    ({}, 0), ({"due_date": None}, 0), ({"due_date": ""}, 0), ({"subject": ""}, 1), ({"subject": "x" * 256}, 1), ({"subject": "x" * 255 + " "}, 0),
    ({"due_date": "Friday"}, 1), ({"due_date": "2024-02-30"}, 1), ({"assigned_to": "nobody@example.com"}, 2), ({"assigned_to": None}, 3),
    ({"assigned_to": " REP5@Example.com "}, 0), ({"assigned_to": "off@example.org"}, 2), ({"assigned_to": "list-service"}, 1),
    ({"created_by": "rep5@example.com"}, 1), ({"created_by": None}, 1), ({"customer_id": " "}, 1),
])
def test_task_create_check(spark, tables, change, reasons):
    base = {
        "session_login": "rep3@example.com", "created_by": "rep3@example.com", "assigned_to": "rep5@example.com",
        "customer_id": "12", "subject": "Call", "due_date": "2024-02-29",
    }
    request = spark.createDataFrame([tuple({**base, **change}.values())], CREATE)
    checked = validate.task_create_check(request, tables.user_access, views.erp_user(tables.erp_users))
    assert len(only(checked)["reasons"]) == reasons, only(checked)
    assert validate.accepted(checked).count() == (reasons == 0)


def test_task_complete_check_keeps_repeated_requests(spark, tables):
    everything = views.all_tasks(tables.activity_trans, tables.task_outbox, views.erp_user(tables.erp_users))
    asked = spark.createDataFrame(
        [("rep3@example.com", "2"), ("rep3@example.com", "2"), ("rep3@example.com", "4"), ("admin@example.com", "4"),
         ("admin@example.com", "999999999"), ("admin@example.com", "abc"), ("off@example.org", "4"), ("rep3@example.com", None)],
        "login string, activity_trans_no string",
    )
    found = rows(validate.task_complete_check(asked, everything, scope.enabled_logins(tables.user_access)))
    accepted = [r[:2] for r in found if not r[2]]
    assert accepted == [("admin@example.com", "4"), ("rep3@example.com", "2"), ("rep3@example.com", "2")]
    assert len(found) == 8


def test_resolve_requests(spark, bench_of):
    b = bench_of("rep3@example.com")
    mine = b.customer_dim.select("customer_id").first()[0]
    fields = "request_id string, customer_id string, assigned_to string, activity_id string, subject string, comments string, due_date string, transaction_kind string, transaction_no string"
    asked = [
        ("me", mine, "Me", "call", " s ", None, "2024-01-31", "quote", " 7 "), ("blank", mine, "", None, "s", "c", "Friday", "memo", "7"),
        ("one", mine, "ada adm", "xyz", "s", "c", None, None, None), ("many", mine, "example", "CALL", "s", "c", None, None, None),
        ("none", mine, "zed", "CALL", "s", "c", None, None, None), ("other", "999999999", "me", "CALL", "s", "c", None, None, None),
    ]
    found = {r["request_id"]: r for r in b.draft_tasks(spark.createDataFrame(asked, fields)).collect()}
    me = found["me"]
    assert (me["assigned_to"], me["activity_id"], me["transaction_type_cd"], me["transaction_no"], me["subject"]) == ("rep3@example.com", "CALL", 709, "7", "s")
    assert me["due_date"] == dt.date(2024, 1, 31) and me["comments"] == "" and me["error"] is None
    blank = found["blank"]
    assert (blank["assigned_to"], blank["activity_id"], blank["due_date"], blank["transaction_type_cd"], blank["transaction_no"]) == ("rep3@example.com", "CUST_FU", None, None, None)
    assert found["one"]["assigned_to"] == "admin@example.com" and found["one"]["type_label"] == "Follow up with customer"
    assert "several" in found["many"]["error"] and "no user" in found["none"]["error"] and "not visible" in found["other"]["error"]


# --- week list -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def week(tables):
    return WeekList(tables, Settings(), AS_OF, 10)


def test_week_list_sections_and_books(week, bench_of):
    sections = week.sections().collect()
    order = [r["section"] for r in sorted((r for r in sections if r["login"] == "rep3@example.com"), key=lambda r: r["position"])]
    assert order == ["stale_quotes", "going_quiet", "reorder_due", "category_gaps", "tasks", "new_accounts"]
    assert {r["login"] for r in sections} == {"admin@example.com", "manager@example.com", "rep3@example.com", "rep5@example.com"}
    own = {r[0] for r in bench_of("rep3@example.com").customer_dim.select("customer_id").collect()}
    found = week.rows().where("login = 'rep3@example.com' AND section <> 'tasks'").collect()
    assert found and all(r["customer_id"] in own and r["customer_name"] in r["question"] for r in found)


def test_week_documents_are_one_json_per_login(week):
    whole = {r["login"]: json.loads(r["document"]) for r in week.documents().collect()}
    assert whole["admin@example.com"]["scope"] == "all accounts" and whole["rep3@example.com"]["scope"].startswith("accounts assigned to ")
    assert {d["generated_at"] for d in whole.values()} == {str(AS_OF)}
    docs = {login: d["sections"] for login, d in whole.items()}
    assert len(docs) == 4 and all(s["blurb"] == K.SECTION_BLURBS[s["key"]] for d in docs.values() for s in d)
    for sections in docs.values():
        assert [s["position"] for s in sections] == [1, 2, 3, 4, 5, 6]
        assert all([r["rank"] for r in s["rows"]] == list(range(1, len(s["rows"]) + 1)) for s in sections)


def test_week_list_write_replaces_its_day(spark, week):
    path = tempfile.mkdtemp(prefix="week-") + "/list"
    week.write(path)
    first = spark.read.parquet(path).count()
    week.write(path)
    assert spark.read.parquet(path).count() == first > 0


@pytest.mark.parametrize("value,want", [
    (950, "$950"), (9999, "$9,999"), (10000, "$10K"), (10500, "$10K"), (11500, "$12K"), (999999, "$1000K"), (1000000, "$1M"), (1250000, "$1.3M"), (-5, "$-5"), (0, "$0"),
])
def test_compact_money(spark, value, want):
    assert spark.range(1).select(compact(F.lit(value).cast("decimal(28,0)"))).first()[0] == want


def test_money(spark):
    df = spark.sql("SELECT CAST(1234.5 AS DECIMAL(10,1)) AS a, CAST(NULL AS DECIMAL(10,1)) AS b, CAST(-1234 AS DECIMAL(10,1)) AS c")
    assert tuple(df.select(money("a"), money("b"), money("c")).first()) == ("$1,235", "", "$-1,234")


# --- sinks ---------------------------------------------------------------------------
def test_upsert_keeps_the_latest_change(spark):
    current = spark.createDataFrame([("a", 1, None), ("b", 2, None)], "k string, v int, by string")
    changes = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    got = sinks.upsert(current, changes, ["k"], [F.col("seq").desc()], {"by": F.lit("me")})
    assert rows(got) == [("a", 1, None), ("b", 4, "me"), ("c", 5, "me")]


def test_seed_and_remap(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    seeds = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "k string, v int")
    assert rows(sinks.seed_if_absent(current, seeds, ["k"])) == [("a", 1), ("b", 2), ("c", 3)]
    mapping = spark.createDataFrame([("a", "z"), ("b", "a"), ("x", "y")], "old string, new string")
    assert rows(sinks.key_remap(current, mapping, "k")) == [("b", 2), ("z", 1)]


def test_audit_failure_is_not_raised(spark):
    events = spark.createDataFrame([("u", "s", "sql", 1, 2)], "user_name string, session_id string, kind string, ms int, row_count int")
    events = events.withColumn("payload", F.struct(F.lit("x").alias("q"), F.lit(None).cast("string").alias("n")))
    path = tempfile.mkdtemp(prefix="audit-")
    assert sinks.append_audit(events, path + "/log") and sinks.append_audit(events, path + "/log")
    log = spark.read.parquet(path + "/log")
    assert log.count() == 2 and log.first()["payload"] == '{"q":"x","n":null}' and log.select("id").distinct().count() == 2
    assert sinks.append_audit(events, "nosuchfs://x/y") is False
    assert sinks.append_audit(events.drop("payload"), path + "/log") is False


def test_outbox_test_rows_are_for_admins(spark):
    asked = spark.createDataFrame(
        [("a@b.co", "12", "C@d.co", "s", None, "", True, "admin"), ("a@b.co", "12", "c@d.co", "s", "2024-01-02", "call", True, "rep")],
        "created_by string, customer_id string, assigned_to string, subject string, due_date string, activity_id string, test boolean, role string",
    )
    found = sinks.outbox_creates(asked)
    assert rows(found, "status", "attempts", "activity_id", "assigned_to") == [("failed", 3, "CUST_FU", "c@d.co"), ("pending", 0, "call", "c@d.co")]


def test_outbox_stream_appends_each_request_once(spark, tables):
    root = tempfile.mkdtemp(prefix="stream-")
    line = {"session_login": "rep3@example.com", "created_by": "rep3@example.com", "assigned_to": "rep5@example.com", "customer_id": "12", "subject": "Call"}

    def deliver(name, *changes):
        import os

        os.makedirs(root + "/in", exist_ok=True)
        with open(f"{root}/in/{name}.json", "w") as f:
            f.writelines(json.dumps({**line, **c}) + "\n" for c in changes)
        query = stream.ingest_creates(
            stream.request_stream(spark, root + "/in"), tables.user_access, views.erp_user(tables.erp_users),
            root + "/outbox", root + "/rejects", root + "/checkpoint",
        )
        query.awaitTermination()

    deliver("a", {}, {"subject": ""})
    deliver("b", {"subject": "Second"})
    assert rows(spark.read.parquet(root + "/outbox"), "subject") == [("Call",), ("Second",)]
    assert spark.read.parquet(root + "/rejects").count() == 1


def test_fact_layout_round_trip(spark, tables):
    root = tempfile.mkdtemp(prefix="erp-")
    for name in ("invoice_sales", "customers", "user_access"):
        source.replace_table(getattr(tables, name), root, name, 3)
    loaded = source.load(spark, root)
    assert loaded.invoice_sales.count() == tables.invoice_sales.count()
    plan = source.since(loaded.invoice_sales, "invoice_date", F.lit("2001-01-15").cast("date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fact_month" in plan
    want = rows(views.customer_pg_12m(tables.invoice_sales, AS_OF))
    assert rows(views.customer_pg_12m(loaded.invoice_sales, AS_OF)) == want


def test_guarded_select_reads_quoted_names_and_literals(bench_of):
    b = bench_of("admin@example.com")
    assert b.run_select("SELECT 'UnresolvedRelation [x]' AS a FROM book.customer").first()["a"] == "UnresolvedRelation [x]"
    assert b.run_select("SELECT count(*) AS n FROM `book`.`customer`").first()["n"] == b.customer_dim.count()
    inner = "SELECT (WITH q AS (SELECT 1 AS n) SELECT max(n) FROM q) AS n, (SELECT count(*) FROM elsewhere) AS m"
    assert "elsewhere" in only(b.run_select(inner))["error"]


def test_upsert_folds_keys(spark):
    current = spark.createDataFrame([("a@x", 1), ("B@x", 2)], "k string, v int")
    changes = spark.createDataFrame([("A@x ", 5, 1), ("a@X", 6, 2), ("c@x", 7, 1)], "k string, v int, seq int")
    found = sinks.upsert(current, changes, ["k"], [F.col("seq").desc()], {}, fold=True)
    assert rows(found) == [("a@x", 6), ("b@x", 2), ("c@x", 7)]


def test_key_remap_keeps_keys_unique(spark):
    current = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, v int")
    mapping = spark.createDataFrame([("a", "z"), ("b", "z"), ("c", "d"), ("d", "y"), ("d", "x"), ("q", "w"), (None, "v"), ("a", None)], "old string, new string")
    assert rows(sinks.key_remap(current, mapping, "k")) == [("b", 2), ("c", 3), ("x", 4), ("z", 1)]
    kept = sinks.usable_renames(current, mapping, "k").where("usable")
    assert rows(kept, "old", "new") == [("a", "z"), ("d", "x")]


def test_seeds_are_picked_by_order(spark):
    seeds = spark.createDataFrame([("a", 9), ("a", 3), ("b", 1)], "k string, v int")
    assert rows(sinks.seed_if_absent(spark.createDataFrame([("b", 5)], "k string, v int"), seeds, ["k"])) == [("a", 3), ("b", 5)]


def test_completed_tasks_reach_the_outbox(bench_of, spark):
    b = bench_of("admin@example.com")
    asked = b.t.activity_trans.select("activity_trans_no").limit(3).unionByName(spark.createDataFrame([("no number",)], "activity_trans_no string"))
    checked = b.check_task_completes(asked)
    done = sinks.outbox_completes(validate.accepted(checked)).collect()
    assert {(r["op"], r["status"], r["created_by"]) for r in done} <= {("complete", "pending", "admin@example.com")}
    assert validate.rejected(checked).where("activity_trans_no = 'no number'").count() == 1


def test_tools_prune_months(spark, tables):


    root = tempfile.mkdtemp(prefix="facts-")
    for name in schemas.TABLES:
        source.replace_table(getattr(tables, name), root, name, 2 if name in schemas.FACTS else None)
    b = Workbench(spark, partial(source.load, root=root), "admin@example.com", AS_OF, Settings())
    for df in (b.recent_activity(), b.open_quotes(), b.cancelled_quotes(), b.going_quiet(), b.reorder_due(), b.stale_quotes()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("fact_month" in x for x in plan.split("PartitionFilters")[1:]), plan[:500]


def test_people_are_found_by_all_words_as_in_a_scan(spark):
    rng = random.Random(4)
    first, last = ["Ann", "Anna", "Bo", "Čeněk", "Dee Dee", "X", ""], ["Lee", "Leeds", "O'Hara", "Smith", "Smithson", "Q"]
    people = [(f"u{i}@{rng.choice(['a', 'mail', 'x'])}.example", None if i % 97 == 0 else f"{rng.choice(first)} {rng.choice(last)}{i % 1000}") for i in range(10_000)]
    asked = ["ann", "lee12", "smith 7", "o'hara999", "x q", "u12@", "u1234@a", "mail u55", "z", "nobody", "dee dee lee3", "ČENĚK leeds5", "7 7 7", "@", "u9999@"]
    who = spark.createDataFrame([("me@example.com", w) for w in asked], "login string, who string")
    found = tasks._resolve_people(who, spark.createDataFrame(people, "login string, name string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    theirs = {}
    for w in asked:
        fits = [(p, n) for p, n in people if all(x in f"{(n or '').lower()}\n{p}" for x in w.lower().split(" ") if x)]
        if fits:
            theirs[w] = (len(fits), min(p for p, _ in fits))
    assert {r["who"]: (r["hits"], r["person"]) for r in found.collect()} == theirs and len(theirs) > 10


def test_a_statement_over_its_time_ends_as_an_error_and_leaves_no_job(bench_of, spark):
    b = bench_of("admin@example.com")
    slow = "SELECT count(*) AS n FROM book.sales_line a JOIN book.sales_line c ON a.customer_id > c.customer_id OR length(a.item_desc) > length(c.item_desc) + a.line_no"
    start = time.monotonic()
    found = guard.guarded_select(b.session, slow, seconds=1)
    assert only(found)["error"] == "the statement took more than 1 seconds" and time.monotonic() - start < 60
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert b.run_select("SELECT count(*) AS n FROM book.customer").first()["n"] == b.customer_dim.count()
    assert not spark.sparkContext.getJobTags()


def test_requests_pass_once_by_event_time_and_late_ones_are_kept(spark, tables):
    root = tempfile.mkdtemp(prefix="stream-")
    line = {"session_login": "rep3@example.com", "created_by": "rep3@example.com", "assigned_to": "rep5@example.com", "customer_id": "12"}

    def deliver(name, *sent):
        os.makedirs(root + "/in", exist_ok=True)
        with open(f"{root}/in/{name}.json", "w") as f:
            f.writelines(json.dumps({**line, "request_id": i, "subject": f"{i} {name}", "sent_at": at and f"2024-06-30T{at}:00Z"}) + "\n" for i, at in sent)
        query = stream.ingest_creates(
            stream.request_stream(spark, root + "/in", schema=stream.TIMED_CREATE_REQUEST), tables.user_access,
            views.erp_user(tables.erp_users), root + "/outbox", root + "/rejects", root + "/checkpoint", delay="1 hour",
        )
        query.awaitTermination()
        assert query.exception() is None

    deliver("a", ("r1", "10:00"), ("r2", "12:00"), ("r2", "12:00"), (None, "11:30"))
    deliver("b", ("r2", "12:00"), ("r3", "11:30"), ("r4", "10:30"))  # the watermark is at 11:00
    deliver("c", ("r3", "11:45"), ("r1", "10:00"), ("r5", "15:00"), ("r6", None))
    deliver("d", ("r2", "12:00"), ("r7", "14:30"))
    assert sorted(r["subject"].split(" ")[0] for r in spark.read.parquet(root + "/outbox").collect()) == ["None", "r1", "r2", "r3", "r5", "r7"]
    late = [(r["request_id"], r["reasons"]) for r in spark.read.parquet(root + "/rejects").collect()]
    assert sorted(x for x, _ in late) == ["r1", "r2", "r4", "r6"] and all(y == [stream.TOO_LATE] for _, y in late)


def test_a_replace_is_seen_whole_or_not_at_all(spark, tables):
    root, first, second = tempfile.mkdtemp(prefix="erp-"), tables.customers.limit(5), tables.customers.limit(9)
    old = source.replace_table(first, root, "customers")
    before = source.load(spark, root).customers
    new = source.replace_table(second, root, "customers")
    assert old != new and before.count() == 5 and source.load(spark, root).customers.count() == 9

    broken = first.withColumn("customer_name", F.when(F.rand() >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("customer_name")))
    with pytest.raises(Exception, match="lost"):
        source.replace_table(broken, root, "customers")
    assert source.current_path(spark, root, "customers") == new and source.load(spark, root).customers.count() == 9
    assert source.drop_old_versions(spark, root, "customers", keep=1) >= 1
    assert source.load(spark, root).customers.count() == 9 and not os.path.exists(old)

    # a table written without versions is read as it is
    tables.customers.limit(3).write.parquet(root + "/plain/customers")
    assert source.load(spark, root + "/plain").customers.count() == 3
