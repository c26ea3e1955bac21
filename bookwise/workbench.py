"""All tools for one login: scoped data in, one DataFrame out per question.

Every tool takes a set of subjects (customer ids), so a single account and a whole
book run the same plan. Subjects outside the login's scope yield no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise import constants as K
from bookwise.context import Scope, Settings
from bookwise.functions.staging import stage
from bookwise.operators import customer, guard, peers, scope, search, tasks, triggers, validate, views
from bookwise.sources.tables import Tables


class Workbench:
    """``build`` makes the tables in a session, e.g. ``partial(tables.load, root=path)``."""

    def __init__(
        self, spark: SparkSession, build: Callable[[SparkSession], Tables], login: str, as_of=None,
        settings: Settings | None = None,
    ):
        self._spark, self._build = spark, build
        self.t = build(spark)
        self.as_of = as_of
        self.scope = Scope.resolve(self.t.user_access, login)
        self.settings = settings or Settings.load(self.t.list_settings)

    def _mine(self, df: DataFrame) -> DataFrame:
        return scope.scoped(df, self.t.customers, self.scope)

    # --- scoped views ------------------------------------------------------------
    @property
    def _everyone(self) -> DataFrame:
        """All customers, whatever the scope: peers may be anybody."""
        return views.customer_all(self.t.customers, self.t.salesreps)

    @cached_property
    def customer_dim(self) -> DataFrame:
        return self._mine(self._everyone)

    # Tools read the visible facts themselves: these still have the month their windows
    # are pruned by, which the exposed line views do not.
    @cached_property
    def _sales(self) -> DataFrame:
        return self._mine(self.t.invoice_sales)

    @cached_property
    def _quotes(self) -> DataFrame:
        return self._mine(self.t.open_quotes)

    @cached_property
    def sales_line(self) -> DataFrame:
        return self._mine(views.line_view(self.t.invoice_sales, "sales_line"))

    @cached_property
    def open_quote_line(self) -> DataFrame:
        return self._mine(views.line_view(self.t.open_quotes, "open_quote_line"))

    @cached_property
    def open_order_line(self) -> DataFrame:
        return self._mine(views.line_view(self.t.open_orders, "open_order_line"))

    @cached_property
    def cancelled_quote_line(self) -> DataFrame:
        return self._mine(views.line_view(self.t.cancelled_quotes, "cancelled_quote_line"))

    @cached_property
    def _rollup_all(self) -> DataFrame:
        """Unscoped rollup for the peer tools, written once and read by each of them."""
        return stage(views.customer_pg(self.t.invoice_sales, self.as_of), "rollup")

    @cached_property
    def customer_pg_12m(self) -> DataFrame:
        return self._mine(views.pg_12m(self._rollup_all))

    @cached_property
    def customer_pg_ltd(self) -> DataFrame:
        return self._mine(views.pg_ltd(self._rollup_all))

    @cached_property
    def customer_vector(self) -> DataFrame:
        return self._mine(views.customer_vector(views.pg_12m(self._rollup_all)))

    @cached_property
    def class_pg_penetration(self) -> DataFrame:
        return views.penetration_of(self._rollup_all, self.t.customers, self.scope)

    @cached_property
    def salesrep(self) -> DataFrame:
        return views.salesrep(self.t.salesreps, self.t.customers, self.scope)

    @cached_property
    def task(self) -> DataFrame:
        users = views.erp_user(self.t.erp_users)
        return views.task(self.t.activity_trans, self.t.task_outbox, users, self.t.customers, self.scope)

    def freshness(self) -> DataFrame:
        return views.freshness(self.sales_line)

    def _visible(self, subjects: DataFrame | None) -> DataFrame:
        mine = scope.scope_customer(self.t.customers, self.scope)
        return mine if subjects is None else mine.join(subjects.select("customer_id").distinct(), "customer_id", "left_semi")

    def _figures(self) -> DataFrame:
        return customer.account_figures(self.customer_pg_12m, self.customer_pg_ltd)

    # --- tools ---------------------------------------------------------------------
    def find_customer(self, queries: DataFrame) -> DataFrame:
        return search.search_customer(self.customer_dim, self._figures(), queries)

    def customers_near(self, places: DataFrame, limit: int | None = None) -> DataFrame:
        return customer.customers_near(self.customer_dim, self._figures(), places, limit)

    def draft_tasks(self, requests: DataFrame) -> DataFrame:
        """Resolve requests; ``login`` is taken from the workbench."""
        logins = scope.enabled_logins(self.t.user_access)
        people = scope.people(self.t.user_access, views.erp_user(self.t.erp_users))
        mine = requests.withColumn("login", F.lit(self.scope.login))
        scopes = tasks.scope_customers(logins, self.t.customers)
        return tasks.resolve_requests(mine, scopes, logins, people, self.t.task_type)

    def customer_snapshot(self, subjects: DataFrame | None = None) -> DataFrame:
        return customer.customer_snapshot(
            self.customer_dim, self._sales, self._quotes, self._mine(self.t.open_orders), self.customer_pg_12m,
            subjects, self.as_of,
        )

    def lookalikes(self, subjects: DataFrame | None = None, n: int = K.LOOKALIKES) -> DataFrame:
        return peers.lookalikes(
            views.pg_12m(self._rollup_all), self._everyone, self._visible(subjects), n, self.scope.sees_all
        )

    def lookalike_gap(self, subjects: DataFrame | None = None, n: int = K.LOOKALIKES, min_pct: float = K.GAP_MIN_PCT) -> DataFrame:
        pg = self._rollup_all
        return peers.lookalike_gap(views.pg_12m(pg), views.pg_ltd(pg), self._visible(subjects), n, min_pct, self._everyone)

    def peer_gap(self, subjects: DataFrame | None = None, min_pct: float = K.GAP_MIN_PCT, n: int | None = None) -> DataFrame:
        pg = self._rollup_all
        return peers.peer_gap(
            views.pg_12m(pg), views.pg_ltd(pg), self._everyone, self._visible(subjects), min_pct, n, self.scope.sees_all
        )

    def class_gap(self, subjects: DataFrame | None = None, min_pct: float = K.GAP_MIN_PCT) -> DataFrame:
        return peers.class_gap(
            self.customer_dim, self.class_pg_penetration, self.customer_pg_12m, self.customer_pg_ltd, subjects, min_pct
        )

    def class_overview(self, classes: DataFrame, top: int | None = None) -> DataFrame:
        return peers.class_overview(self.class_pg_penetration, classes, top)

    def recent_activity(self, subjects: DataFrame | None = None, months: int | None = None) -> DataFrame:
        return customer.recent_activity(self._sales, subjects, months, self.as_of)

    def open_quotes(self, subjects: DataFrame | None = None, max_age_days: int | None = None) -> DataFrame:
        return customer.open_quotes(self._quotes, subjects, max_age_days, self.as_of)

    def cancelled_quotes(self, subjects: DataFrame | None = None, months: int | None = None) -> DataFrame:
        return customer.cancelled_quotes(self._mine(self.t.cancelled_quotes), subjects, months, self.as_of)

    def category_gaps(self, top: int | None = None, min_pct: float | None = None) -> DataFrame:
        mine = self.customer_dim.select(F.lit("mine").alias("scope_key"), "customer_id", "customer_name")
        pg = self._rollup_all
        return peers.category_gaps(
            mine, views.pg_12m(pg), views.pg_ltd(pg), self.settings, top, min_pct, self._everyone
        ).drop("scope_key")

    def run_select(self, sql: str) -> DataFrame:
        return guard.guarded_select(self.session, sql)

    # --- triggers, tasks, checks ------------------------------------------------------
    def stale_quotes(self) -> DataFrame:
        return triggers.stale_quotes(self._quotes, self.settings, self.as_of)

    def going_quiet(self) -> DataFrame:
        return triggers.going_quiet(self._sales, self.settings, self.as_of)

    def reorder_due(self) -> DataFrame:
        return triggers.reorder_due(self._sales, self.settings, self.as_of)

    def new_accounts(self) -> DataFrame:
        return triggers.new_accounts(self._sales, self.settings, self.as_of)

    def task_feed(self, everyone: bool = False) -> DataFrame:
        return tasks.task_feed(self.task, self.scope, everyone)

    def check_task_creates(self, requests: DataFrame) -> DataFrame:
        stamped = requests.withColumn("session_login", F.lit(self.scope.login))
        return validate.task_create_check(stamped, self.t.user_access, views.erp_user(self.t.erp_users))

    def check_task_completes(self, requests: DataFrame) -> DataFrame:
        """Check requests (activity_trans_no) to complete tasks; accepted ones go to ``sinks.outbox_completes``."""
        stamped = requests.withColumn("login", F.lit(self.scope.login))
        everything = views.all_tasks(self.t.activity_trans, self.t.task_outbox, views.erp_user(self.t.erp_users))
        return validate.task_complete_check(stamped, everything, scope.enabled_logins(self.t.user_access))

    @cached_property
    def session(self) -> SparkSession:
        """Isolated session whose temp views are this login's scoped views."""
        return guard.isolated_session(
            self._spark, lambda other: guard.scoped_views(self._build(other), self.scope, self.as_of)
        )
