"""Task feed, open tasks per login, and the batch form of drafting a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookwise import constants as K
from bookwise.context import Scope, as_of_column
from bookwise.functions.columns import top_rows
from bookwise.functions.contains import piece_index, rarest_piece


def _due_order() -> list[Column]:
    return [
        F.col("due_date").asc_nulls_last(),
        F.col("date_created").desc(),
        F.col("activity_trans_no").asc_nulls_last(),
        F.col("outbox_id").asc_nulls_last(),
    ]


def task_feed(task: DataFrame, scope: Scope, everyone: bool = False, limit: int = K.TASK_FEED_ROWS) -> DataFrame:
    """Open tasks, the login's own or (managers only) everybody's; a NULL flag is not open."""
    open_tasks = task.where(~F.col("completed"))
    if not (everyone and scope.sees_all):
        open_tasks = open_tasks.where(F.col("assigned_to_login") == scope.login)
    return (
        open_tasks.orderBy(*_due_order())
        .limit(limit)
        .select(
            "activity_trans_no", "activity_id", "subject", "comments", "due_date", "completed", "assigned_by_name",
            "assigned_to_name", "assigned_to_login", "customer_id", "customer_name", "source", "outbox_id",
            "outbox_status", F.col("date_created").cast("date").alias("created"),
        )
    )


def _assigned_open(logins: DataFrame, all_tasks: DataFrame) -> DataFrame:
    return all_tasks.where(~F.col("completed")).join(
        logins.select(F.col("login").alias("assigned_to_login")), "assigned_to_login", "left_semi"
    )


def open_tasks(logins: DataFrame, all_tasks: DataFrame, customers: DataFrame) -> DataFrame:
    """The eight next open tasks assigned to each login, with the customer name in its book.

    ``logins`` comes from ``scope.enabled_logins``. A task assigned to a login is
    always visible to it, so one pass serves every login; a login with a third of
    all tasks still ships eight rows per partition.
    """
    mine = _assigned_open(logins, all_tasks)
    best = top_rows(mine, ["assigned_to_login"], _due_order(), K.SECTION_ROWS, rank="rank")
    book = customers.select("customer_id", F.col("customer_name").alias("name"), F.col("salesrep_id").alias("owner"))
    who = logins.select(F.col("login").alias("assigned_to_login"), "sees_all", "scope_key")
    visible = F.col("sees_all") | (F.concat(F.lit("rep:"), "owner") == F.col("scope_key"))
    return (
        best.join(who, "assigned_to_login")
        .join(book, "customer_id", "left")
        .select(
            F.col("assigned_to_login").alias("login"), "rank", "activity_trans_no", "activity_id", "subject", "due_date",
            "assigned_by_name", "customer_id", F.when(visible, F.col("name")).alias("customer_name"), "source",
        )
    )


def open_task_totals(logins: DataFrame, all_tasks: DataFrame, shown: DataFrame, as_of=None) -> DataFrame:
    """Open tasks per login; overdue counts only the rows shown."""
    counts = _assigned_open(logins, all_tasks).groupBy(F.col("assigned_to_login").alias("login")).agg(
        F.count(F.lit(1)).alias("tasks")
    )
    late = shown.groupBy("login").agg(F.count_if(F.col("due_date") <= as_of_column(as_of)).alias("overdue"))
    zero = F.lit(0).cast("bigint")
    return (
        logins.select("login")
        .join(counts, "login", "left")
        .join(late, "login", "left")
        .select("login", F.coalesce("tasks", zero).alias("tasks"), F.coalesce("overdue", zero).alias("overdue"))
    )


def strict_date(text: Column | str) -> Column:
    """yyyy-MM-dd or NULL, never an error."""
    text = F.trim(text)
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _resolve_people(asked: DataFrame, people: DataFrame) -> DataFrame:
    """(login, who) -> the one person meant, and how many fit.

    Requests repeat the same few texts, so each distinct pair is resolved once; the
    word test then meets the user table alone.
    """
    who = asked.select("login", "who").distinct()
    candidates = people.select(F.col("login").alias("person"), F.col("name").alias("person_name"))
    # a mail address shared by two ERP users keeps its first name
    unique = candidates.groupBy("person").agg(F.min("person_name").alias("person_name"))
    means_me = (F.lower("who") == "me") | (F.col("who") == "")
    by_login = F.when(means_me, F.col("login")).otherwise(F.lower("who"))
    exact = who.withColumn("person", by_login).join(unique, "person").select("login", "who", "person", "person_name")
    rest = who.join(exact.select("login", "who"), ["login", "who"], "left_anti")
    words = F.filter(F.split(F.lower("who"), " "), lambda w: w != "")
    hay = F.concat_ws("\n", F.lower(F.coalesce("person_name", F.lit(""))), F.lower("person"))
    listed = candidates.withColumn("text", hay)
    index = piece_index(listed, "text")
    # a person who fits has every piece of every word: people meet requests on the rarest one
    probes = rarest_piece(rest.withColumn("words", words), ["login", "who", "words"], F.col("words"), index)
    fits = F.forall("words", lambda w: F.contains(F.col("lowered"), w))
    by_words = (
        probes.join(index.postings, "piece").where(fits).select("login", "who", "text")
        .join(listed, "text")
        .groupBy("login", "who")
        .agg(F.count(F.lit(1)).alias("hits"), F.min("person").alias("person"), F.min("person_name").alias("person_name"))
    )
    return exact.withColumn("hits", F.lit(1).cast("bigint")).unionByName(by_words)


def resolve_requests(
    requests: DataFrame, scope_customers: DataFrame, logins: DataFrame, people: DataFrame, task_type: DataFrame
) -> DataFrame:
    """Turn loosely worded task requests into drafts, or say what is wrong.

    ``requests``: request_id, login, customer_id, assigned_to, activity_id, subject,
    comments, due_date, transaction_kind, transaction_no (strings).
    ``scope_customers``: scope_key, customer_id, customer_name.
    """
    clean = requests.select(
        "request_id",
        F.lower(F.trim("login")).alias("login"),
        F.trim(F.coalesce("customer_id", F.lit(""))).alias("customer_id"),
        F.trim(F.coalesce("assigned_to", F.lit(""))).alias("who"),
        F.upper(F.trim(F.coalesce("activity_id", F.lit(K.DEFAULT_TASK_TYPE)))).alias("activity_id"),
        F.trim(F.coalesce("subject", F.lit(""))).alias("subject"),
        F.trim(F.coalesce("comments", F.lit(""))).alias("comments"),
        strict_date("due_date").alias("due_date"),
        F.lower(F.trim(F.coalesce("transaction_kind", F.lit("")))).alias("kind"),
        F.trim(F.coalesce("transaction_no", F.lit(""))).alias("transaction_no"),
    )
    first_type = task_type.agg(F.min(F.struct("sort", "activity_id", "label")).alias("first"))
    typed = clean.join(task_type.select("activity_id", "label"), "activity_id", "left")
    # the first type is one row; requests without a known type meet it on a constant
    unknown = F.when(F.col("label").isNull(), F.lit(1))
    typed = typed.withColumn("unknown", unknown).join(first_type.withColumn("unknown", F.lit(1)), "unknown", "left").select(
        *[c for c in clean.columns if c != "activity_id"],
        F.when(F.col("label").isNull(), F.col("first.activity_id")).otherwise(F.col("activity_id")).alias("activity_id"),
        F.coalesce("label", "first.label").alias("type_label"),
    )
    kinds = F.create_map(*[F.lit(x) for pair in K.DOCUMENT_KINDS.items() for x in pair])
    keyed = typed.join(logins.select("login", "scope_key"), "login", "left")
    named = keyed.join(scope_customers, ["scope_key", "customer_id"], "left")
    resolved = named.join(_resolve_people(clean, people), ["login", "who"], "left")
    single = F.col("hits") == 1
    hits = F.coalesce("hits", F.lit(0))
    error = (
        F.when(F.col("customer_name").isNull(), F.concat(F.lit("customer "), "customer_id", F.lit(" is not visible to this user")))
        .when(hits == 0, F.concat(F.lit("no user matches '"), "who", F.lit("'")))
        .when(hits > 1, F.concat(F.lit("'"), "who", F.lit("' matches several people")))
    )
    code = F.try_element_at(kinds, F.col("kind"))
    return resolved.select(
        "request_id", "login", "activity_id", "type_label", "customer_id", "customer_name",
        F.when(single, F.col("person")).alias("assigned_to"),
        F.when(single, F.col("person_name")).alias("assigned_to_name"),
        "subject", "comments", "due_date",
        code.alias("transaction_type_cd"),
        F.when(code.isNotNull(), F.col("transaction_no")).alias("transaction_no"),
        error.alias("error"),
    )


def scope_customers(logins: DataFrame, customers: DataFrame) -> DataFrame:
    """(scope_key, customer_id, customer_name): each customer once under '*' and once under its rep.

    Two rows per customer at most, whatever the number of logins.
    """
    keys = F.array_compact(F.array(F.lit("*"), F.concat(F.lit("rep:"), "salesrep_id")))
    spread = customers.select(F.explode(keys).alias("scope_key"), "customer_id", "customer_name")
    return spread.join(logins.select("scope_key").distinct(), "scope_key", "left_semi")

