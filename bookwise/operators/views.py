"""Semantic layer: customer dimension, line facts, rollups, penetration, tasks.

Functions take DataFrames that are already scoped (or not) by ``scope.scoped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookwise import constants as K, schemas
from bookwise.context import Scope, months_before
from bookwise.functions.columns import blank_to_null, full_name, not_other_charge, percent
from bookwise.sources.tables import since

_OPEN_COLUMNS = [f.name for f in schemas.OPEN_QUOTES.fields]
LINE_COLUMNS = {
    "sales_line": [f.name for f in schemas.INVOICE_SALES.fields],
    "open_quote_line": _OPEN_COLUMNS,
    "open_order_line": [f.name for f in schemas.OPEN_ORDERS.fields],
    "cancelled_quote_line": [f.name for f in schemas.CANCELLED_QUOTES.fields],
}


def customer_all(customers: DataFrame, salesreps: DataFrame) -> DataFrame:
    """Customer dimension with rep name and cleaned address."""
    reps = salesreps.select(F.col("id").alias("salesrep_id"), full_name("first_name", "last_name").alias("salesrep_name"))
    return customers.join(reps, "salesrep_id", "left").select(
        "customer_id",
        "customer_name",
        "customer_class",
        "salesrep_id",
        "salesrep_name",
        blank_to_null("phys_address1").alias("address"),
        blank_to_null("phys_city").alias("city"),
        blank_to_null("phys_state").alias("state"),
        F.nullif(F.left(F.trim("phys_zip"), F.lit(5)), F.lit("")).alias("zip"),
        blank_to_null("phone").alias("phone"),
    )


def line_view(fact: DataFrame, name: str) -> DataFrame:
    """Line-level fact with the exposed columns only (a cost column never shows)."""
    return fact.select(*LINE_COLUMNS[name])


def daily_sales(sales: DataFrame) -> DataFrame:
    """Invoice lines compacted per customer, group, day, charge flag and their names.

    Sums, extremes and days survive, so the rollups, penetration and cadence operators
    take this table in place of the lines and share one scan of them.
    The day is part of the key: a customer with a third of the lines still spreads over
    many tasks, and lines combine before they are shuffled.
    """
    flag = F.when(not_other_charge(), "N").otherwise("Y")
    keys = ["customer_id", "customer_name", "product_group_id", "product_group_desc", "invoice_date"]
    return sales.groupBy(*keys, flag.alias("other_charge_item")).agg(
        F.sum("extended_price").alias("extended_price"), F.count(F.lit(1)).alias("lines")
    )


def _lines(sales: DataFrame) -> Column:
    return F.col("lines") if "lines" in sales.columns else F.lit(1).cast("bigint")


# The rollups aggregate twice. MAX of a text column cannot be held in a hash aggregation
# buffer, so Spark would sort all lines for it; with the text in the key the lines go
# through a hash aggregation, and only its short result is reduced once more. That second
# step is partitioned by customer, which everything per customer downstream reuses.


def customer_pg_12m(sales: DataFrame, as_of=None) -> DataFrame:
    """Customer x product group over the last 12 months, other charges excluded."""
    return (
        since(sales, "invoice_date", months_before(as_of, 12))
        .where(not_other_charge())
        .groupBy("customer_id", "product_group_id", "product_group_desc")
        .agg(
            F.sum("extended_price").alias("sales_12m"),
            F.sum(_lines(sales)).alias("lines_12m"),
            F.max("invoice_date").alias("last_invoice_date"),
        )
        .repartition("customer_id")
        .groupBy("customer_id", "product_group_id")
        .agg(
            F.max("product_group_desc").alias("product_group_desc"),
            F.sum("sales_12m").alias("sales_12m"),
            F.sum("lines_12m").alias("lines_12m"),
            F.max("last_invoice_date").alias("last_invoice_date"),
        )
    )


def customer_pg_ltd(sales: DataFrame) -> DataFrame:
    """Customer x product group over all history, other charges excluded."""
    return (
        sales.where(not_other_charge())
        .groupBy("customer_id", "product_group_id", "product_group_desc")
        .agg(
            F.sum("extended_price").alias("sales_ltd"),
            F.sum(_lines(sales)).alias("lines_ltd"),
            F.min("invoice_date").alias("first_invoice_date"),
            F.max("invoice_date").alias("last_invoice_date"),
        )
        .repartition("customer_id")
        .groupBy("customer_id", "product_group_id")
        .agg(
            F.max("product_group_desc").alias("product_group_desc"),
            F.sum("sales_ltd").alias("sales_ltd"),
            F.sum("lines_ltd").alias("lines_ltd"),
            F.min("first_invoice_date").alias("first_invoice_date"),
            F.max("last_invoice_date").alias("last_invoice_date"),
        )
    )


def customer_pg(sales: DataFrame, as_of=None) -> DataFrame:
    """One scan of the history for everything kept per customer and product group.

    ``pg_12m``, ``pg_ltd`` and ``penetration_of`` read it; ``first_line_date`` is the
    first day of any line, other charges included.
    """
    goods = not_other_charge()
    recent = F.col("invoice_date") >= months_before(as_of, 12)
    lines, none = _lines(sales), F.lit(0).cast("bigint")
    return reduce_pg(
        sales.groupBy("customer_id", "product_group_id", "product_group_desc").agg(
            F.sum(F.when(recent & goods, F.col("extended_price"))).alias("sales_12m"),
            F.sum(F.when(recent & goods, lines).otherwise(none)).alias("lines_12m"),
            F.sum(F.when(recent, lines).otherwise(none)).alias("any_lines_12m"),
            F.sum(F.when(goods, F.col("extended_price"))).alias("sales_ltd"),
            F.sum(F.when(goods, lines).otherwise(none)).alias("lines_ltd"),
            F.min(F.when(goods, F.col("invoice_date"))).alias("first_invoice_date"),
            F.max(F.when(goods, F.col("invoice_date"))).alias("last_invoice_date"),
            F.min("invoice_date").alias("first_line_date"),
        )
    )


def reduce_pg(named: DataFrame) -> DataFrame:
    """``customer_pg`` from its sums per customer, group and group name."""
    return (
        named.repartition("customer_id")
        .groupBy("customer_id", "product_group_id")
        .agg(
            F.max(F.when(F.col("lines_12m") > 0, F.col("product_group_desc"))).alias("desc_12m"),
            F.sum("sales_12m").alias("sales_12m"),
            F.sum("lines_12m").alias("lines_12m"),
            F.sum("any_lines_12m").alias("any_lines_12m"),
            F.max(F.when(F.col("lines_ltd") > 0, F.col("product_group_desc"))).alias("desc_ltd"),
            F.sum("sales_ltd").alias("sales_ltd"),
            F.sum("lines_ltd").alias("lines_ltd"),
            F.min("first_invoice_date").alias("first_invoice_date"),
            F.max("last_invoice_date").alias("last_invoice_date"),
            F.min("first_line_date").alias("first_line_date"),
        )
    )


def pg_12m(pg: DataFrame) -> DataFrame:
    # with any recent line, the last line of all is recent
    return pg.where("lines_12m > 0").select(
        "customer_id", "product_group_id", F.col("desc_12m").alias("product_group_desc"), "sales_12m", "lines_12m",
        "last_invoice_date",
    )


def pg_ltd(pg: DataFrame) -> DataFrame:
    return pg.where("lines_ltd > 0").select(
        "customer_id", "product_group_id", F.col("desc_ltd").alias("product_group_desc"), "sales_ltd", "lines_ltd",
        "first_invoice_date", "last_invoice_date",
    )


def customer_vector(pg12: DataFrame) -> DataFrame:
    """Unit-length purchase mix in long form; only groups with positive sales.

    A customer has at most one row per product group, so the window partition is
    bounded by that dimension however many lines the customer has. The norm is an
    exact sum, so it does not depend on the order of the rows.
    """
    sales = F.col("sales_12m").cast("double")
    exact = F.col("sales_12m").cast("decimal(18,2)")
    norm = F.sqrt(F.sum(exact * exact).over(Window.partitionBy("customer_id")).cast("double"))
    return pg12.where("sales_12m > 0").select(
        "customer_id", "product_group_id", "sales_12m", F.try_divide(sales, norm).alias("w")
    )


def class_pg_penetration(sales: DataFrame, customers: DataFrame, as_of=None, scope: Scope | None = None) -> DataFrame:
    """Share of a market class's active customers that buy each product group, from the lines.

    Lines collapse to one row per customer and group first: no distinct over the lines,
    and a class that holds most of them is combined before it is shuffled.
    """
    goods = not_other_charge()
    per_group = (
        since(sales, "invoice_date", months_before(as_of, 12))
        .groupBy("customer_id", "product_group_id", "product_group_desc")
        .agg(F.count_if(goods).alias("lines"), F.sum(F.when(goods, F.col("extended_price"))).alias("sales"))
        .repartition("customer_id")
        .groupBy("customer_id", "product_group_id")
        .agg(
            F.max(F.when(F.col("lines") > 0, F.col("product_group_desc"))).alias("product_group_desc"),
            F.sum("lines").alias("lines"),
            F.sum("sales").alias("sales"),
        )
    )
    return _penetration(per_group, customers, scope)


def penetration_of(pg: DataFrame, customers: DataFrame, scope: Scope | None = None) -> DataFrame:
    """The same from ``customer_pg``, without another scan of the lines."""
    per_group = pg.where("any_lines_12m > 0").select(
        "customer_id", "product_group_id", F.col("desc_12m").alias("product_group_desc"),
        F.col("lines_12m").alias("lines"), F.col("sales_12m").alias("sales"),
    )
    return _penetration(per_group, customers, scope)


def _penetration(per_group: DataFrame, customers: DataFrame, scope: Scope | None) -> DataFrame:
    """A buyer is a (customer, group) row with lines, an active customer is its first row.

    Other charges alone make a customer active but not a buyer.
    """
    first = F.row_number().over(Window.partitionBy("customer_id").orderBy("product_group_id")) == 1
    classes = customers.where("customer_class IS NOT NULL").select("customer_id", "customer_class")
    if scope is not None and not scope.enabled:
        classes = classes.where(F.lit(False))
    counted = (
        per_group.withColumn("first", first)
        .join(classes, "customer_id")
        .groupBy("customer_class", "product_group_id", "product_group_desc")
        .agg(
            F.count_if(F.col("lines") > 0).alias("buyers"),
            F.sum("sales").alias("sales"),
            F.count_if("first").alias("active"),
        )
        # from here on one row per class, group and name
        .groupBy("customer_class", "product_group_id")
        .agg(
            F.max("product_group_desc").alias("product_group_desc"),
            F.sum("buyers").alias("buyers_12m"),
            F.sum("sales").alias("class_sales_12m"),
            F.sum("active").alias("active"),
        )
    )
    whole_class = Window.partitionBy("customer_class")
    sized = counted.withColumn("active_customers", F.sum("active").over(whole_class)).where("buyers_12m > 0")
    return sized.select(
        "customer_class",
        "product_group_id",
        "product_group_desc",
        "buyers_12m",
        "active_customers",
        F.round(percent(F.col("buyers_12m"), F.col("active_customers")), 1).alias("penetration_pct"),
        "class_sales_12m",
        F.round(F.try_divide("class_sales_12m", "buyers_12m"), 2).alias("avg_sales_per_buyer"),
    )


def salesrep(salesreps: DataFrame, customers: DataFrame, scope: Scope) -> DataFrame:
    """Reps with their number of customers; admins only."""
    reps = salesreps.select(F.col("id").alias("salesrep_id"), full_name("first_name", "last_name").alias("salesrep_name"))
    if not scope.is_admin:
        reps = reps.where(F.lit(False))
    counts = customers.groupBy("salesrep_id").agg(F.count(F.lit(1)).alias("customers"))
    return reps.join(counts, "salesrep_id", "left").withColumn("customers", F.coalesce("customers", F.lit(0).cast("bigint")))


def erp_user(erp_users: DataFrame) -> DataFrame:
    """Login (lower-cased mail) to ERP user id."""
    return erp_users.where("email_address IS NOT NULL").select(
        F.lower("email_address").alias("login"), F.col("id").alias("erp_user_id"), "name"
    )


def freshness(sales: DataFrame) -> DataFrame:
    return sales.agg(F.max("invoice_date").alias("sales_current_to"))


def all_tasks(activity_trans: DataFrame, task_outbox: DataFrame, erp_user: DataFrame) -> DataFrame:
    """Activity rows plus outbox creates not yet applied, with both people's names.

    ``assigned_by_login`` / ``created_by`` are kept so that a visibility rule can be
    applied for one login or for all of them.
    """
    recorded = activity_trans.select(
        "activity_trans_no",
        "activity_id",
        "subject",
        "comments",
        F.col("target_complete_date").cast("date").alias("due_date"),
        (F.col("completed_flag") == "Y").alias("completed"),
        "completed_date",
        F.col("assigned_by_id").alias("assigned_by_erp"),
        F.col("assigned_to_id").alias("assigned_to_erp"),
        F.when(F.col("link_type_cd") == K.LINK_CUSTOMER, F.col("link_id")).alias("customer_id"),
        "transaction_type_cd",
        "transaction_no",
        "date_created",
        F.lit("erp").alias("source"),
        F.lit(None).cast("string").alias("outbox_id"),
        F.lit(None).cast("string").alias("outbox_status"),
        F.lit(None).cast("string").alias("outbox_by"),
        F.lit(None).cast("string").alias("outbox_to"),
    )
    ids = erp_user.select("login", "erp_user_id")
    sender = ids.select(F.col("login").alias("created_by"), F.col("erp_user_id").alias("assigned_by_erp"))
    receiver = ids.select(F.col("login").alias("assigned_to"), F.col("erp_user_id").alias("assigned_to_erp"))
    pending = (
        task_outbox.where((F.col("op") == "create") & F.col("status").isin("pending", "processing", "failed"))
        .join(sender, "created_by", "left")
        .join(receiver, "assigned_to", "left")
        .select(
            F.lit(None).cast("string").alias("activity_trans_no"),
            "activity_id",
            "subject",
            "comments",
            "due_date",
            F.lit(False).alias("completed"),
            F.lit(None).cast("timestamp").alias("completed_date"),
            "assigned_by_erp",
            "assigned_to_erp",
            "customer_id",
            "transaction_type_cd",
            "transaction_no",
            F.col("created_at").alias("date_created"),
            F.lit("outbox").alias("source"),
            F.col("id").alias("outbox_id"),
            F.col("status").alias("outbox_status"),
            F.col("created_by").alias("outbox_by"),
            F.col("assigned_to").alias("outbox_to"),
        )
    )
    by = erp_user.select(
        F.col("erp_user_id").alias("assigned_by_erp"),
        F.col("name").alias("assigned_by_name"),
        F.col("login").alias("assigned_by_login"),
    )
    to = erp_user.select(
        F.col("erp_user_id").alias("assigned_to_erp"),
        F.col("name").alias("assigned_to_name"),
        F.col("login").alias("assigned_to_login"),
    )
    return recorded.unionByName(pending).join(by, "assigned_by_erp", "left").join(to, "assigned_to_erp", "left")


TASK_COLUMNS = [
    "activity_trans_no", "activity_id", "subject", "comments", "due_date", "completed", "completed_date",
    "assigned_by_erp", "assigned_to_erp", "customer_id", "transaction_type_cd", "transaction_no", "date_created",
    "source", "outbox_id", "outbox_status", "assigned_by_name", "assigned_to_name", "assigned_to_login",
    "customer_name",
]


def task(
    activity_trans: DataFrame, task_outbox: DataFrame, erp_user: DataFrame, customers: DataFrame, scope: Scope
) -> DataFrame:
    """Tasks one login may see; the customer name only for customers in scope."""
    if not scope.enabled:
        activity_trans, task_outbox = activity_trans.where(F.lit(False)), task_outbox.where(F.lit(False))
    elif not scope.sees_all:
        # filter both inputs before the name joins; one scan of the activity rows
        mine = erp_user.where(F.col("login") == scope.login).select("erp_user_id").distinct()
        to_me = mine.select(F.col("erp_user_id").alias("assigned_to_id"), F.lit(True).alias("_to_me"))
        by_me = mine.select(F.col("erp_user_id").alias("assigned_by_id"), F.lit(True).alias("_by_me"))
        activity_trans = (
            activity_trans.join(to_me, "assigned_to_id", "left")
            .join(by_me, "assigned_by_id", "left")
            .where(F.coalesce("_to_me", "_by_me", F.lit(False)))
        )
        task_outbox = task_outbox.where((F.col("assigned_to") == scope.login) | (F.col("created_by") == scope.login))
    if scope.sees_all:
        names = customers
    elif scope.my_rep is None:
        names = customers.where(F.lit(False))
    else:
        names = customers.where(F.col("salesrep_id") == scope.my_rep)
    tasks = all_tasks(activity_trans, task_outbox, erp_user)
    # tasks of no customer are most of some logins' rows; they stay out of the join, where NULL would be one hot key
    of_none = tasks.where("customer_id IS NULL").withColumn("customer_name", F.lit(None).cast("string"))
    of_one = tasks.where("customer_id IS NOT NULL").join(names.select("customer_id", "customer_name"), "customer_id", "left")
    return of_one.select(*TASK_COLUMNS).unionByName(of_none.select(*TASK_COLUMNS))
