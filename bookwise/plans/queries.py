"""Every operator on the mapped tables, as (spark, sf_dir) -> DataFrame.

Money and ratios leave as double, arrays as '|'-joined text, so that any engine can
compare the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bookwise import constants as K
from bookwise.context import Scope, Settings, months_before
from bookwise.functions.staging import scratch_path, stage
from bookwise.operators import customer, guard, peers, scope, search, tasks, triggers, validate, views
from bookwise.operators.monthly import MonthlyHistory
from bookwise.operators.weeklist import WeekList
from bookwise.sources import fixture, sinks
from bookwise.sources.keyed import KeyedTable
from bookwise.sources.tables import Tables

AS_OF = fixture.AS_OF
GAP_PCT = 10
TOP = 10
#: Buckets of the stored keyed tables.
BUCKETS = 32
_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

ADMIN = Scope("admin@example.com", "admin", None)
REP = Scope("rep3@example.com", "rep", "3")


# plans only: the mapping is described once per session, its data is read by each query
_tables = lru_cache(maxsize=4)(fixture.tables)


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(_tables(spark, sf_dir)))

    _REGISTRY[build.__name__] = run
    return build


def comparable(df: DataFrame) -> DataFrame:
    def shape(field: T.StructField) -> Column:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType)):
            col = col.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|", "NULL")
        return col.alias(field.name)

    return df.select(*[shape(f) for f in df.schema.fields])


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def _dim(t: Tables) -> DataFrame:
    return views.customer_all(t.customers, t.salesreps)


def _pg(t: Tables) -> DataFrame:
    """Everything per customer and group, staged: one scan of the lines for every reader."""
    return stage(views.customer_pg(t.invoice_sales, AS_OF), "rollup")


def _rollups(t: Tables) -> tuple[DataFrame, DataFrame]:
    pg = _pg(t)
    return views.pg_12m(pg), views.pg_ltd(pg)


def _recent(t: Tables) -> DataFrame:
    return stage(views.customer_pg_12m(t.invoice_sales, AS_OF), "rollup-12m")


def _top_subjects(pg12: DataFrame) -> DataFrame:
    """The ten biggest accounts."""
    totals = pg12.groupBy("customer_id").agg(F.sum("sales_12m").alias("sales"))
    return stage(totals.orderBy(F.col("sales").desc(), "customer_id").limit(TOP).select("customer_id"), "subjects")


# --- semantic layer --------------------------------------------------------------
@query
def customer_dim(t: Tables) -> DataFrame:
    return _dim(t)


@query
def sales_line_scoped(t: Tables) -> DataFrame:
    return scope.scoped(views.line_view(t.invoice_sales, "sales_line"), t.customers, REP)


@query
def open_quote_line_scoped(t: Tables) -> DataFrame:
    return scope.scoped(views.line_view(t.open_quotes, "open_quote_line"), t.customers, REP)


@query
def open_order_line_scoped(t: Tables) -> DataFrame:
    return scope.scoped(views.line_view(t.open_orders, "open_order_line"), t.customers, REP)


@query
def cancelled_quote_line_scoped(t: Tables) -> DataFrame:
    return scope.scoped(views.line_view(t.cancelled_quotes, "cancelled_quote_line"), t.customers, REP)


@query
def customer_pg_12m(t: Tables) -> DataFrame:
    return views.customer_pg_12m(t.invoice_sales, AS_OF)


@query
def customer_pg_ltd(t: Tables) -> DataFrame:
    return views.customer_pg_ltd(t.invoice_sales)


@query
def customer_vector(t: Tables) -> DataFrame:
    vector = views.customer_vector(views.customer_pg_12m(t.invoice_sales, AS_OF))
    return vector.withColumn("w", F.round("w", 9))


@query
def class_pg_penetration(t: Tables) -> DataFrame:
    return views.class_pg_penetration(t.invoice_sales, t.customers, AS_OF, REP)


@query
def salesrep_counts(t: Tables) -> DataFrame:
    return views.salesrep(t.salesreps, t.customers, ADMIN)


@query
def task_view(t: Tables) -> DataFrame:
    task = views.task(t.activity_trans, t.task_outbox, views.erp_user(t.erp_users), t.customers, REP)
    return task.select(
        "activity_trans_no", "activity_id", "subject", "due_date", "completed", "assigned_by_erp", "assigned_to_erp",
        "customer_id", "source", "outbox_id", "outbox_status", "assigned_by_name", "assigned_to_name",
        "assigned_to_login", "customer_name",
    )


@query
def freshness(t: Tables) -> DataFrame:
    return views.freshness(t.invoice_sales)


@query
def scope_customer(t: Tables) -> DataFrame:
    """Visible customers of every login, in one join."""
    scopes = tasks.scope_customers(scope.enabled_logins(t.user_access), t.customers)
    return scope.enabled_logins(t.user_access).join(scopes, "scope_key").select("login", "customer_id")


@query
def login_directory(t: Tables) -> DataFrame:
    return scope.login_directory(t.user_access, t.customers, t.salesreps, views.erp_user(t.erp_users))


# --- peers -------------------------------------------------------------------------
@query
def lookalikes(t: Tables) -> DataFrame:
    pg12 = _recent(t)
    return peers.lookalikes(pg12, _dim(t), _top_subjects(pg12))


@query
def lookalikes_all(t: Tables) -> DataFrame:
    """Look-alikes of every customer."""
    return peers.lookalikes(_recent(t), _dim(t), None)


@query
def lookalike_gap(t: Tables) -> DataFrame:
    pg12, ltd = _rollups(t)
    return peers.lookalike_gap(pg12, ltd, _top_subjects(pg12), K.LOOKALIKES, GAP_PCT, t.customers)


@query
def lookalike_gap_all(t: Tables) -> DataFrame:
    """The gaps of every customer."""
    pg12, ltd = _rollups(t)
    return peers.lookalike_gap(pg12, ltd, None, K.LOOKALIKES, GAP_PCT, t.customers)


@query
def category_gaps(t: Tables) -> DataFrame:
    pg12, ltd = _rollups(t)
    scopes = tasks.scope_customers(scope.enabled_logins(t.user_access), t.customers)
    return peers.category_gaps(scopes, pg12, ltd, Settings(), None, GAP_PCT, t.customers)


@query
def peer_gap(t: Tables) -> DataFrame:
    pg12, ltd = _rollups(t)
    return _listed_peers(peers.peer_gap(pg12, ltd, _dim(t), _top_subjects(pg12), GAP_PCT))


@query
def peer_gap_all(t: Tables) -> DataFrame:
    """Peers and gaps of every customer that bought in the last 12 months."""
    pg12, ltd = _rollups(t)
    return _listed_peers(peers.peer_gap(pg12, ltd, _dim(t), pg12.select("customer_id"), GAP_PCT))


def _listed_peers(found: DataFrame) -> DataFrame:
    return found.select(
        "subject_id",
        F.transform("top_lookalikes", lambda x: F.concat_ws("/", x["customer_name"], x["similarity"].cast("decimal(4,3)").cast("string"))).alias("top_lookalikes"),
        F.transform("gaps", lambda x: F.concat_ws("/", x["product_group_id"], x["penetration_pct"].cast("decimal(5,1)").cast("string"), x["status"])).alias("gaps"),
        "note",
    )


@query
def class_gap(t: Tables) -> DataFrame:
    pg = _pg(t)
    penetration = views.penetration_of(pg, t.customers, ADMIN)
    return peers.class_gap(_dim(t), penetration, views.pg_12m(pg), views.pg_ltd(pg), None)


@query
def class_overview(t: Tables) -> DataFrame:
    penetration = views.class_pg_penetration(t.invoice_sales, t.customers, AS_OF, ADMIN)
    classes = t.customers.select(F.lower("customer_class").alias("customer_class")).where("customer_class IS NOT NULL")
    return peers.class_overview(penetration, classes, 10)


# --- triggers --------------------------------------------------------------------
@query
def stale_quotes(t: Tables) -> DataFrame:
    return triggers.stale_quotes(t.open_quotes, Settings(), AS_OF)


@query
def going_quiet(t: Tables) -> DataFrame:
    return triggers.going_quiet(t.invoice_sales, Settings(), AS_OF)


@query
def reorder_due(t: Tables) -> DataFrame:
    return triggers.reorder_due(t.invoice_sales, Settings().replace(reorder_min_orders=3), AS_OF)


@query
def new_accounts(t: Tables) -> DataFrame:
    return triggers.new_accounts(t.invoice_sales, Settings(), AS_OF)


def _week(t: Tables) -> WeekList:
    return WeekList(t, Settings(), AS_OF, GAP_PCT)


@query
def section_totals(t: Tables) -> DataFrame:
    return _week(t).sections().select("login", "section", "count", "total")


@query
def section_rows(t: Tables) -> DataFrame:
    return _week(t).rows().select("login", "section", "rank", "customer_id", "dollars")


@query
def row_text(t: Tables) -> DataFrame:
    return _week(t).rows().select("login", "section", "rank", "customer_name", "detail", "question")


@query
def week_list(t: Tables) -> DataFrame:
    return _week(t).assembled()


@query
def week_documents(t: Tables) -> DataFrame:
    return _week(t).documents()


@query
def open_tasks(t: Tables) -> DataFrame:
    logins = scope.enabled_logins(t.user_access)
    everything = views.all_tasks(t.activity_trans, t.task_outbox, views.erp_user(t.erp_users))
    return tasks.open_tasks(logins, everything, t.customers)


@query
def task_feed(t: Tables) -> DataFrame:
    task = views.task(t.activity_trans, t.task_outbox, views.erp_user(t.erp_users), t.customers, ADMIN)
    return tasks.task_feed(task, ADMIN, everyone=True).drop("comments", "created")


# --- per customer -----------------------------------------------------------------
def _figures(t: Tables) -> DataFrame:
    return customer.account_figures(*_rollups(t))


@query
def find_customer(t: Tables) -> DataFrame:
    """Every customer id, the tail of every name and every town are looked up."""
    asked = t.customers.select(
        F.explode(
            F.array("customer_id", F.right("customer_name", F.lit(4)), F.concat(F.lit("CUSTOMER#"), F.right("customer_name", F.lit(2))), F.lit("Customer%99"), F.lit("#"))
        ).alias("query")
    )
    return search.find_customer(_dim(t), _figures(t), asked)


def _word_names(t: Tables) -> DataFrame:
    """The customers under names with words: what their dearest line was for, and a number."""
    dearest = t.invoice_sales.groupBy("customer_id").agg(
        F.max(F.struct("extended_price", "item_desc"))["item_desc"].alias("item"), F.max("customer_name").alias("old_name"),
        F.sum("extended_price").alias("year_sales"), F.max("invoice_date").alias("last_invoice"),
    )
    name = F.concat("item", F.lit(" "), F.right("old_name", F.lit(5))).alias("customer_name")
    return stage(dearest.select("customer_id", name, "item", "year_sales", "last_invoice"), "word-names")


def _dim_of(names: DataFrame) -> DataFrame:
    empty = ["customer_class", "salesrep_name", "address", "city", "state", "zip", "phone"]
    return names.select("customer_id", "customer_name", *[F.lit(None).cast("string").alias(c) for c in empty])


@query
def find_customer_trigram(t: Tables) -> DataFrame:
    """The trigram arm alone: every item name, misspelt, against all item names."""
    items = t.invoice_sales.groupBy(F.col("item_desc").alias("customer_name")).agg(F.min("item_id").alias("customer_id"))
    items = stage(items, "items")
    asked = items.select(F.concat(F.col("customer_name"), F.lit("x")).alias("query"))
    names = _dim_of(items).withColumn("name_trigrams", search.trigrams("customer_name"))
    queries = asked.withColumn("query_trigrams", search.trigrams("query"))
    return search._trigram_matches(names, queries).select("query", F.col("customer_id"))


@query
def find_customer_fuzzy(t: Tables) -> DataFrame:
    """Names as they are misheard, other vowels in all words, against all customers' names."""
    names = _word_names(t)
    asked = names.select(F.translate("item", "aeiou", "eioua").alias("query")).distinct()
    figures = names.select("customer_id", "year_sales", "last_invoice")
    found = search.search_customer(_dim_of(names), figures, asked)
    return found.select("query", "customer_id", "customer_name", F.col("sales_12m").cast("double").alias("sales_12m"), F.col("name_similarity").cast("double").alias("name_similarity"), "note")


@query
def customers_near(t: Tables) -> DataFrame:
    """Every town, zip and state of the customers, without one customer."""
    dim = _dim(t)
    places = dim.select(F.explode(F.array("city", "zip", F.lower("state"), F.lit("Nation_1%"))).alias("place")).distinct()
    return customer.customers_near(dim, _figures(t), places.withColumn("exclude_customer_id", F.lit("7")), 10)


@query
def customer_snapshot(t: Tables) -> DataFrame:
    pg12 = _recent(t)
    found = customer.customer_snapshot(
        _dim(t), t.invoice_sales, t.open_quotes, t.open_orders, pg12, None, AS_OF
    )
    groups = F.transform(
        "top_groups",
        lambda g: F.concat_ws("/", g["product_group"], g["sales_12m"].cast("decimal(28,0)").cast("string"), g["last"].cast("string")),
    )
    return found.withColumn("top_groups", groups)


@query
def recent_activity(t: Tables) -> DataFrame:
    return customer.recent_activity(t.invoice_sales, None, 6, AS_OF)


@query
def open_quotes(t: Tables) -> DataFrame:
    return customer.open_quotes(t.open_quotes, None, 180, AS_OF)


@query
def cancelled_quotes(t: Tables) -> DataFrame:
    return customer.cancelled_quotes(t.cancelled_quotes, None, 12, AS_OF)


@query
def vocabulary(t: Tables) -> DataFrame:
    pg = _pg(t)
    return customer.vocabulary(_dim(t), views.pg_12m(pg), views.penetration_of(pg, t.customers, ADMIN))


# --- requests, checks and sinks -------------------------------------------------
def _pick(key: Column, *choices: str | None) -> Column:
    """One of the choices by key."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (key % len(choices) + 1).cast("int"))


def _requests(t: Tables) -> DataFrame:
    """One loosely worded task request per activity row."""
    key = F.col("activity_trans_no").cast("long")
    return t.activity_trans.select(
        F.col("activity_trans_no").alias("request_id"),
        _pick(key, "admin@example.com", "REP3@example.com", "rep5@example.com", "off@example.org").alias("login"),
        (F.col("link_id").cast("long") * 7).cast("string").alias("customer_id"),
        _pick(key, "me", "", "MANAGER@example.com", "rae", "rep example", "nobody", "Ada Admin").alias("assigned_to"),
        _pick(key, "call", None, "VISIT", "dance", "quote fu").alias("activity_id"),
        F.col("subject"),
        F.concat(F.lit(" about "), "subject", F.lit(" ")).alias("comments"),
        _pick(key, "2001-08-09", "Friday", None, "2001-02-30").alias("due_date"),
        _pick(key, "Quote", "order", "opportunity", "letter", None).alias("transaction_kind"),
        F.concat(F.lit("T"), "activity_trans_no").alias("transaction_no"),
    )


@query
def resolve_requests(t: Tables) -> DataFrame:
    logins = scope.enabled_logins(t.user_access)
    people = scope.people(t.user_access, views.erp_user(t.erp_users))
    scopes = tasks.scope_customers(logins, t.customers)
    return tasks.resolve_requests(_requests(t), scopes, logins, people, t.task_type)


def _creates(t: Tables) -> DataFrame:
    """One create request per activity row, right and wrong in every way."""
    key = F.col("activity_trans_no").cast("long")
    login = _pick(key, "admin@example.com", "rep3@example.com", "rep5@example.com")
    return t.activity_trans.select(
        F.col("activity_trans_no").alias("request_id"),
        login.alias("session_login"),
        F.when(key % 17 == 0, "rep5@example.com").otherwise(login).alias("created_by"),
        F.when(key % 13 == 0, " ").otherwise(F.col("link_id")).alias("customer_id"),
        _pick(key, "rep3@example.com", "Manager@example.com", "off@example.org", "list-service", None, "rep5@example.com", "x@example.com").alias("assigned_to"),
        F.when(key % 19 == 0, F.repeat("subject", F.lit(90))).when(key % 23 == 0, "").otherwise(F.col("subject")).alias("subject"),
        _pick(key, "2001-08-09", "Friday", None, "2001-02-30", "").alias("due_date"),
    )


@query
def task_create_check(t: Tables) -> DataFrame:
    checked = validate.task_create_check(_creates(t), t.user_access, views.erp_user(t.erp_users))
    return checked.select("request_id", "reasons")


def _completes(t: Tables) -> DataFrame:
    key = F.col("activity_trans_no").cast("long")
    return t.activity_trans.select(
        _pick(key, "admin@example.com", "rep3@example.com", "rep5@example.com", "off@example.org").alias("login"),
        F.when(key % 10 == 9, F.concat(F.lit("n"), "activity_trans_no"))
        .when(key % 10 == 8, (key + 900_000_000).cast("string"))
        .otherwise(F.col("activity_trans_no"))
        .alias("activity_trans_no"),
    )


def _complete_checked(t: Tables) -> DataFrame:
    everything = views.all_tasks(t.activity_trans, t.task_outbox, views.erp_user(t.erp_users))
    return validate.task_complete_check(_completes(t), everything, scope.enabled_logins(t.user_access))


@query
def task_complete_check(t: Tables) -> DataFrame:
    return _complete_checked(t)


@query
def statement_check(t: Tables) -> DataFrame:
    """A statement per order line of the quotes, in twelve shapes, right and wrong."""
    no = F.col("order_no")
    shapes = [
        F.concat(F.lit("SELECT * FROM book.customer WHERE customer_id = '"), "customer_id", F.lit("'")),
        F.concat(F.lit("with q as (select * from book.open_quote_line where order_no = '"), no, F.lit("') select * from Q")),
        F.concat(F.lit("DELETE FROM book.sales_line WHERE order_no = '"), no, F.lit("'")),
        F.concat(F.lit("SELECT 1; SELECT "), no),
        F.concat(F.lit("SELECT * FROM customers WHERE customer_id = "), "customer_id"),
        F.concat(F.lit("SELECT * FROM book.customer c JOIN other.sales s ON s.id = "), "customer_id"),
        F.concat(F.lit("SELECT "), no, F.lit(" -- note")),
        F.concat(F.lit("SELECT set_config('x', '"), no, F.lit("', true)")),
        F.lit("   "),
        F.concat(F.lit("SELECT EXTRACT(YEAR FROM order_date) FROM book.open_quote_line WHERE order_no = '"), no, F.lit("'")),
        F.concat(F.lit("SELECT * FROM book.customer, public.customers WHERE id = "), "customer_id"),
        F.concat(F.lit("SELECT updated_at, created_by FROM book.customer WHERE customer_id = '"), "customer_id", F.lit("'")),
    ]
    position = ((F.col("order_no").cast("long") + F.col("line_no")) % len(shapes) + 1).cast("int")
    statements = t.open_quotes.select("order_no", "line_no", "item_id", F.element_at(F.array(*shapes), position).alias("sql"))
    return validate.statement_check(statements).select("order_no", "line_no", "item_id", "sql", "reason")


GUARDED_SQL = (
    "WITH big AS (SELECT customer_id, SUM(sales_12m) AS sales FROM book.customer_pg_12m GROUP BY customer_id) "
    "SELECT c.customer_id, c.customer_name, CAST(b.sales AS DOUBLE) AS sales "
    "FROM book.customer c JOIN big b ON b.customer_id = c.customer_id ORDER BY c.customer_id"
)


def guarded_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = guard.isolated_session(spark, lambda s: guard.scoped_views(fixture.tables(s, sf_dir), ADMIN, AS_OF))
    return comparable(guard.guarded_select(session, GUARDED_SQL))


_REGISTRY["guarded_select"] = guarded_select


def guarded_select_fails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that breaks on the data: an error row, no exception."""
    session = guard.isolated_session(spark, lambda s: guard.scoped_views(fixture.tables(s, sf_dir), ADMIN, AS_OF))
    answer = guard.guarded_select(session, "SELECT CAST(customer_name AS INT) AS n FROM book.customer")
    return answer.select(F.lit("guarded").alias("statement"), F.col("error").isNotNull().alias("failed"))


_REGISTRY["guarded_select_fails"] = guarded_select_fails


def _contacts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customer contact rows, and their quote lines as changes, whose keys are written in another case."""
    current = t.customers.select(
        F.concat(F.lit("c"), "customer_id").alias("key"), F.col("phys_city").alias("note"), F.lit(None).cast("string").alias("updated_by")
    )
    changes = t.open_quotes.select(F.concat(F.lit(" C"), "customer_id").alias("key"), F.col("order_no").alias("note"), "order_date")
    return current, changes


def _seeds(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers with a rep are stored; all customers are offered as seeds, twice."""
    rows = t.customers.select("customer_id", "customer_name", F.explode(F.array(F.lit("seed two"), F.lit("seed"))).alias("origin"))
    return t.customers.where("salesrep_id IS NOT NULL").select("customer_id", "customer_name", F.lit("stored").alias("origin")), rows


def _renames(t: Tables) -> DataFrame:
    """Ids move up by one million; odd ones ask for an id that is taken, every eighth for one that another asks for."""
    key = F.col("customer_id").cast("long")
    new = F.when(key % 2 == 1, key - 1).when(key % 8 == 0, key + 1_000_002).otherwise(key + 1_000_000)
    return t.customers.select(F.col("customer_id").alias("old"), new.cast("string").alias("new"))


@query
def upsert_by_key(t: Tables) -> DataFrame:
    """Each contact by its latest quote line."""
    current, changes = _contacts(t)
    order = [F.col("order_date").desc(), F.col("note").desc()]
    return sinks.upsert(current, changes, ["key"], order, {"updated_by": F.lit("admin@example.com")}, fold=True)


@query
def keyed_upsert(t: Tables) -> DataFrame:
    """The same on a stored table, in two changes: older quotes, then newer ones."""
    current, changes = _contacts(t)
    stored = KeyedTable.create(current, scratch_path(t.customers.sparkSession, "keyed"), "contacts", ["key"], BUCKETS, fold=True)
    order = [F.col("order_date").desc(), F.col("note").desc()]
    newer = F.coalesce(F.col("order_date") >= months_before(AS_OF, 6), F.lit(False))
    for step in (~newer, newer):
        stored.upsert(changes.where(step), order, {"updated_by": F.lit("admin@example.com")})
    return stored.read()


@query
def seed_if_absent(t: Tables) -> DataFrame:
    stored, rows = _seeds(t)
    return sinks.seed_if_absent(stored, rows, ["customer_id"])


@query
def keyed_seed(t: Tables) -> DataFrame:
    """The same on a stored table, offered twice."""
    current, rows = _seeds(t)
    stored = KeyedTable.create(current, scratch_path(t.customers.sparkSession, "keyed"), "customers", ["customer_id"], BUCKETS)
    for _ in range(2):
        stored.seed(rows)
    return stored.read()


@query
def key_remap(t: Tables) -> DataFrame:
    return sinks.key_remap(t.customers.select("customer_id", "customer_name"), _renames(t), "customer_id")


@query
def keyed_rename(t: Tables) -> DataFrame:
    """The same on a stored table."""
    current = t.customers.select("customer_id", "customer_name")
    stored = KeyedTable.create(current, scratch_path(t.customers.sparkSession, "keyed"), "customers", ["customer_id"], BUCKETS)
    stored.rename(_renames(t))
    return stored.read()


def _kept_up(t: Tables) -> DataFrame:
    """The rollup of a history that was built three months ago and refreshed since."""
    root = scratch_path(t.invoice_sales.sparkSession, "monthly")
    past = F.coalesce(F.col("invoice_date") < months_before(AS_OF, 3), F.lit(True))
    history = MonthlyHistory.build(t.invoice_sales.where(past), root)
    history.refresh(t.invoice_sales)
    return stage(history.customer_pg(t.invoice_sales, AS_OF), "rollup-monthly")


@query
def monthly_pg_12m(t: Tables) -> DataFrame:
    return views.pg_12m(_kept_up(t))


@query
def monthly_pg_ltd(t: Tables) -> DataFrame:
    return views.pg_ltd(_kept_up(t))


@query
def json_export(t: Tables) -> DataFrame:
    rows = views.customer_pg_12m(t.invoice_sales, AS_OF)
    typed = rows.withColumn("sales_12m", F.col("sales_12m").cast("decimal(18,2)"))
    return sinks.json_rows(typed)


@query
def outbox_append(t: Tables) -> DataFrame:
    checked = validate.task_create_check(_creates(t), t.user_access, views.erp_user(t.erp_users))
    spark = checked.sparkSession
    path = scratch_path(spark, "outbox")
    sinks.append_outbox(sinks.outbox_creates(validate.accepted(checked)), path)
    return spark.read.parquet(path).select(
        "created_by", "op", "activity_id", "customer_id", "assigned_to", "subject", "due_date", "status", "attempts"
    )


@query
def outbox_completes(t: Tables) -> DataFrame:
    checked = _complete_checked(t)
    path = scratch_path(checked.sparkSession, "outbox")
    sinks.append_outbox(sinks.outbox_completes(validate.accepted(checked)), path)
    return checked.sparkSession.read.parquet(path).select("created_by", "op", "activity_trans_no", "status", "attempts")


@query
def audit_append(t: Tables) -> DataFrame:
    spark = t.customers.sparkSession
    path = scratch_path(spark, "audit")
    events = t.activity_trans.select(
        F.col("assigned_to_id").alias("user_name"),
        F.lit("").alias("session_id"),
        F.lit("task_create").alias("kind"),
        F.struct("activity_trans_no", "subject", "comments").alias("payload"),
        F.lit(None).cast("int").alias("ms"),
        F.lit(1).alias("row_count"),
    )
    sinks.append_audit(events, path)
    return spark.read.parquet(path).select("user_name", "session_id", "kind", "payload", "row_count")
