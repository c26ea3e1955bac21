"""The week list for every login in one job.

Triggers run once over the whole population. A trigger row then belongs to at most
two scopes, "*" and its rep's, so ranking and totals are per scope, and logins join
the ranked result at the end: neither the logins nor the managers multiply the facts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from bookwise import constants as K
from bookwise.context import Settings, as_of_column, months_before
from bookwise.functions.columns import top_rows
from bookwise.functions.staging import stage
from bookwise.operators import peers, tasks, triggers, views
from bookwise.operators.scope import enabled_logins, login_directory
from bookwise.sources.tables import Tables, since


def money(value: Column | str) -> Column:
    """$1,234 (halves away from zero); empty for NULL."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(F.round(value, 0), 0)), F.lit(""))


def compact(value: Column) -> Column:
    """$1.2M / $480K / $950 for a headline."""
    million = F.regexp_replace(F.round(value / 1_000_000, 1).cast("decimal(28,1)").cast("string"), r"\.0$", "")
    thousand = F.bround(value / 1000, 0).cast("decimal(28,0)").cast("string")
    return (
        F.when(value >= 1_000_000, F.concat(F.lit("$"), million, F.lit("M")))
        .when(value >= 10_000, F.concat(F.lit("$"), thousand, F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_number(F.round(value, 0), 0)))
    )


def _text(*parts: Column | str) -> Column:
    """Concatenate; a NULL part is empty. Strings are literal text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _whole(name: str) -> Column:
    return F.col(name).cast("decimal(28,0)")


# Fixed values below: the wording of each row is part of the result.
def stale_quote_rows(df: DataFrame) -> DataFrame:
    taker = F.when(F.length("taker") > 0, F.concat(F.lit(" · quoted by "), "taker"))
    value = money("quote_value")
    return _rows(
        df, "stale_quotes", "quote_value", ["order_no"],
        _text("Quote #", F.col("order_no"), " · ", value, " · ", F.col("age_days"), " days old · ", F.col("lines"), " lines", taker),
        value,
        _text(
            "Quote ", F.col("order_no"), " with ", F.col("customer_name"), " is ", F.col("age_days"),
            " days old. What is in it, what else is open with them, and what should I ask on the call?",
        ),
    )


def going_quiet_rows(df: DataFrame) -> DataFrame:
    value = money("sales_12m")
    return _rows(
        df, "going_quiet", "sales_12m", [],
        _text(
            "No invoice for ", F.col("days_silent"), " days, usually every ", _whole("usual_gap_days"), " · ", value,
            " last 12 months · last invoice ", F.col("last_invoice"),
        ),
        value,
        _text(
            F.col("customer_name"), " usually buys every ", _whole("usual_gap_days"), " days and has been quiet for ",
            F.col("days_silent"), ". What were they buying, is anything open, and what changed?",
        ),
    )


def reorder_due_rows(df: DataFrame) -> DataFrame:
    value = money("sales_12m")
    return _rows(
        df, "reorder_due", "sales_12m", ["product_group_id"],
        _text(
            F.col("product_group_desc"), " · every ", _whole("usual_gap_days"), " days, now ", F.col("days_since"), " · ",
            value, " a year in this group",
        ),
        value,
        _text(
            F.col("customer_name"), " buys ", F.col("product_group_desc"), " about every ", _whole("usual_gap_days"),
            " days and it has been ", F.col("days_since"),
            ". What do they usually order in that group and what should I bring up?",
        ),
    )


def category_gap_rows(df: DataFrame) -> DataFrame:
    before = F.when(
        F.col("status").startswith("bought"), _text("last bought ", F.col("my_last_purchase"))
    ).otherwise("never bought")
    more = F.when(F.col("other_gaps") > 0, _text(" · ", F.col("other_gaps"), " more gaps"))
    return _rows(
        df, "category_gaps", "avg_sales_per_buyer", [],
        _text(
            F.col("product_group_desc"), " · ", F.col("penetration_pct").cast("decimal(10,1)"),
            "% of lookalikes buy it, about ", money("avg_sales_per_buyer"), " each · ", before, more,
        ),
        money("sales_12m"),
        _text("What is ", F.col("customer_name"), " not buying that similar customers are?"),
    )


def new_account_rows(df: DataFrame) -> DataFrame:
    value = money("sales_to_date")
    return _rows(
        df, "new_accounts", "sales_to_date", [],
        _text(
            "First invoice ", F.col("first_invoice"), " · ", F.col("invoices"), " invoice(s), ", value, " so far · ",
            F.array_join(F.slice("product_groups", 1, 4), ", "),
        ),
        value,
        _text(
            F.col("customer_name"),
            " is a new account. What have they bought so far, and what do similar customers buy that I should offer next?",
        ),
    )


def task_rows(df: DataFrame) -> DataFrame:
    due = F.when(F.col("due_date").isNotNull(), _text(" · due ", F.col("due_date")))
    sender = F.when(F.col("assigned_by_name").isNotNull(), _text(" · from ", F.col("assigned_by_name")))
    outbox = F.when(F.col("source") == "outbox", " · on its way to the ERP")
    return df.select(
        "login", F.lit("tasks").alias("section"), "rank", "customer_id",
        F.coalesce("customer_name", _text("customer ", F.col("customer_id"))).alias("customer_name"),
        _text(F.col("activity_id"), " · ", F.col("subject"), due, sender, outbox).alias("detail"),
        F.lit("").alias("dollars"),
        _text(
            "I have a task on ", F.coalesce("customer_name", "customer_id"), ": \"", F.col("subject"),
            "\". Brief me on the account before I do it: recent activity, open quotes, anything I should know.",
        ).alias("question"),
        F.col("activity_trans_no").alias("task_no"),
    )


def _rows(df: DataFrame, section: str, amount: str, ties: list[str], detail: Column, dollars: Column, question: Column) -> DataFrame:
    extra = ["scope_key"] if "scope_key" in df.columns else []
    return df.select(
        *extra, "customer_id", "customer_name", F.lit(section).alias("section"),
        F.col(amount).cast("decimal(28,0)").alias("amount"), _text(*[F.col(c) for c in ties]).alias("tie"),
        detail.alias("detail"), dollars.alias("dollars"), question.alias("question"),
    )


def trigger_rows(t: Tables, days: DataFrame, pg: DataFrame, settings: Settings, as_of=None) -> DataFrame:
    """All rows of the four population-wide triggers as text rows, unscoped.

    ``days`` is ``daily_sales`` of the last 24 months, ``pg`` is ``customer_pg``.
    """
    first_days = pg.select("customer_id", F.col("first_line_date").alias("invoice_date"))
    return (
        stale_quote_rows(triggers.stale_quotes(t.open_quotes, settings, as_of))
        .unionByName(going_quiet_rows(triggers.going_quiet(days, settings, as_of)))
        .unionByName(reorder_due_rows(triggers.reorder_due(days, settings, as_of)))
        .unionByName(new_account_rows(triggers.new_accounts(t.invoice_sales, settings, as_of, first_days)))
    )


def in_scopes(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each row once per scope that sees its customer (``scopes``: scope_key, customer_id)."""
    return rows.join(scopes.select("scope_key", "customer_id"), "customer_id")


def rank_rows(rows: DataFrame) -> DataFrame:
    """Top 8 of each scope and section by dollars (12 for gaps)."""
    order = [F.col("amount").desc_nulls_last(), F.col("customer_id").asc(), F.col("tie").asc()]
    best = top_rows(rows, ["scope_key", "section"], order, K.GAP_SECTION_ROWS, rank="rank")
    return best.where((F.col("section") == "category_gaps") | (F.col("rank") <= K.SECTION_ROWS))


def totals(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Count and dollars per scope and section; gaps count the rows they show."""
    zero = F.lit(0).cast("decimal(38,0)")
    counted = rows.where("section <> 'category_gaps'").select("scope_key", "section", "amount")
    gaps = shown.where("section = 'category_gaps'").select("scope_key", "section", "amount")
    return counted.unionByName(gaps).groupBy("scope_key", "section").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("amount"), zero).alias("total")
    )


def _section_table(logins: DataFrame) -> DataFrame:
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(key).alias("section"), F.lit(title).alias("title"))
            for i, (key, title) in enumerate(K.SECTIONS, 1)
        ]
    )
    return logins.select("login", "scope_key", F.inline(listed))


def headline(section: Column, total: Column, overdue: Column, count: Column) -> Column:
    dollars = compact(total)
    late = (
        F.when(count == 0, "nothing open")
        .when(overdue > 0, _text(overdue, " due today or overdue"))
        .otherwise("none overdue")
    )
    return (
        F.when(section == "stale_quotes", _text(dollars, " quoted"))
        .when(section == "going_quiet", _text(dollars, " a year at risk"))
        .when(section == "reorder_due", _text(dollars, " a year in these groups"))
        .when(section == "category_gaps", _text(dollars, " a year if they bought like their peers"))
        .when(section == "new_accounts", _text(dollars, " so far"))
        .otherwise(late)
    )


class WeekList:
    """Sections, totals and rows for enabled mail logins, sharing one set of scans.

    ``logins`` (login) restricts the list; None is everybody. A shared table is
    written when the first result needs it, and once.
    """

    def __init__(self, t: Tables, settings: Settings, as_of=None, gap_min_pct: float | None = None, logins: DataFrame | None = None):
        self.t, self.settings, self.as_of, self.gap_min_pct = t, settings, as_of, gap_min_pct
        everybody = enabled_logins(t.user_access).where(F.col("login").like("%@%"))
        wanted = None if logins is None else logins.select(F.lower(F.trim("login")).alias("login")).distinct()
        self.logins = everybody if wanted is None else everybody.join(wanted, "login", "left_semi")

    @cached_property
    def scoped_rows(self) -> DataFrame:
        t = self.t
        scopes = tasks.scope_customers(self.logins, t.customers)
        # One scan of the history leaves a row per customer and group; one of the last 24
        # months (pruned to their partitions) leaves the days both cadence triggers read.
        pg = stage(views.customer_pg(t.invoice_sales, self.as_of), "rollup")
        recent = since(t.invoice_sales, "invoice_date", months_before(self.as_of, 24))
        days = stage(views.daily_sales(recent), "days")
        gaps = peers.category_gaps(
            scopes, views.pg_12m(pg), views.pg_ltd(pg), self.settings, None, self.gap_min_pct, t.customers
        )
        found = trigger_rows(t, days, pg, self.settings, self.as_of)
        return stage(in_scopes(found, scopes).unionByName(category_gap_rows(gaps)), "week-rows")

    @cached_property
    def ranked(self) -> DataFrame:
        return rank_rows(self.scoped_rows)

    @cached_property
    def _everything(self) -> DataFrame:
        t = self.t
        return views.all_tasks(t.activity_trans, t.task_outbox, views.erp_user(t.erp_users))

    @cached_property
    def tasks(self) -> DataFrame:
        # eight rows per login, read by the rows and the overdue counts
        return stage(tasks.open_tasks(self.logins, self._everything, self.t.customers), "week-tasks")

    @cached_property
    def task_totals(self) -> DataFrame:
        return tasks.open_task_totals(self.logins, self._everything, self.tasks, self.as_of)

    def sections(self) -> DataFrame:
        """(login, position, section, title, count, total, headline), all six for each login."""
        scope_totals = totals(self.scoped_rows, self.ranked)
        joined = (
            _section_table(self.logins)
            .join(scope_totals, ["scope_key", "section"], "left")
            .join(self.task_totals, "login", "left")
        )
        zero = F.lit(0).cast("bigint")
        count = F.when(F.col("section") == "tasks", F.col("tasks")).otherwise(F.coalesce("count", zero))
        total = F.coalesce("total", F.lit(0).cast("decimal(38,0)"))
        return joined.select(
            "login", "position", "section", "title", count.alias("count"), total.alias("total"),
            headline(F.col("section"), total, F.col("overdue"), count).alias("headline"),
        )

    def rows(self) -> DataFrame:
        """(login, section, rank, customer, detail, dollars, question, task_no)."""
        mine = self.ranked.join(self.logins.select("login", "scope_key"), "scope_key").select(
            "login", "section", "rank", "customer_id", "customer_name", "detail", "dollars", "question",
            F.lit(None).cast("string").alias("task_no"),
        )
        return mine.unionByName(task_rows(self.tasks))

    def assembled(self) -> DataFrame:
        """Sections left-joined with their rows: an empty section keeps one line."""
        return self.sections().join(self.rows(), ["login", "section"], "left")

    def documents(self) -> DataFrame:
        """One JSON document per login: scope, day and sections. A login holds at most 6 sections of 12 rows."""
        item = F.struct("rank", "customer_id", "customer_name", "detail", "dollars", "question", "task_no")
        listed = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), item)))
        per_section = self.assembled().groupBy("login", "position", "section", "title", "count", "headline").agg(
            listed.alias("rows")
        )
        blurbs = F.create_map(*[F.lit(x) for pair in K.SECTION_BLURBS.items() for x in pair])
        section = F.struct(
            "position", F.col("section").alias("key"), "title", blurbs[F.col("section")].alias("blurb"), "count", "headline", "rows"
        )
        per_login = per_section.groupBy("login").agg(F.array_sort(F.collect_list(section)).alias("sections"))
        t = self.t
        known = login_directory(t.user_access, t.customers, t.salesreps, views.erp_user(t.erp_users))
        day = F.date_format(as_of_column(self.as_of), "yyyy-MM-dd").alias("generated_at")
        document = F.struct(F.col("scope_text").alias("scope"), day, "sections")
        return per_login.join(known.select("login", "scope_text").distinct(), "login").select(
            "login", F.to_json(document, {"ignoreNullFields": "false"}).alias("document")
        )

    def write(self, path: str) -> None:
        """Full snapshot of this as-of day; older days stay."""
        day = F.current_date() if self.as_of is None else F.lit(str(self.as_of)).cast("date")
        dated = self.assembled().withColumn("as_of", day)
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)
