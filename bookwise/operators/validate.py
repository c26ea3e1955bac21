"""Batch checks: each returns its input with ``reasons`` / ``reason`` and never drops rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bookwise import constants as K
from bookwise.operators.tasks import strict_date


def _reasons(*checks: tuple[Column, str]) -> Column:
    # a NULL test counts as failed: nothing slips through on a missing value
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), text) for ok, text in checks]))


def task_create_check(requests: DataFrame, user_access: DataFrame, erp_user: DataFrame) -> DataFrame:
    """Check task-create requests against the rules for the outbox.

    ``requests`` has session_login, created_by, assigned_to, customer_id, subject and
    due_date (text). An empty due date is fine; a malformed one is not.
    """
    to = F.lower(F.trim("assigned_to"))
    users = user_access.where("enabled").select(F.col("login").alias("_to"), F.lit(True).alias("_user")).distinct()
    known = erp_user.select(F.col("login").alias("_to"), F.lit(True).alias("_erp")).distinct()
    checked = requests.withColumn("_to", to).join(users, "_to", "left").join(known, "_to", "left")
    due_given = F.coalesce(F.trim("due_date"), F.lit("")) != ""
    filled = [F.coalesce(F.trim(c), F.lit("")) != "" for c in ("customer_id", "assigned_to", "subject")]
    reasons = _reasons(
        (filled[0] & filled[1] & filled[2], "customer, assignee and subject are required"),
        (F.length(F.trim(F.coalesce("subject", F.lit("")))) <= 255, "subject must be 255 characters or fewer"),
        (~due_given | strict_date("due_date").isNotNull(), "due date must be yyyy-MM-dd"),
        (F.lower(F.trim("created_by")) == F.lower(F.trim("session_login")), "created_by must be the session login"),
        (F.col("_user"), "assignee is not an enabled user"),
        (F.col("_erp"), "assignee has no ERP user with that email"),
    )
    return checked.withColumn("reasons", reasons).drop("_to", "_user", "_erp")


def task_complete_check(requests: DataFrame, all_tasks: DataFrame, logins: DataFrame) -> DataFrame:
    """Check task-complete requests (login, activity_trans_no): well-formed and visible to the login."""
    asked = requests.select("activity_trans_no").distinct()
    both = F.array_compact(F.array("assigned_by_login", "assigned_to_login"))
    # one row per task; a shared mail address can name more than two people
    seen = (
        all_tasks.join(asked, "activity_trans_no", "left_semi")
        .groupBy("activity_trans_no")
        .agg(F.array_distinct(F.flatten(F.collect_set(both))).alias("_seen_by"))
    )
    checked = requests.join(logins.select("login", "sees_all"), "login", "left").join(seen, "activity_trans_no", "left")
    # an unknown or disabled login has NULL sees_all and sees nothing
    visible = F.col("_seen_by").isNotNull() & (F.col("sees_all") | (F.col("sees_all").isNotNull() & F.array_contains("_seen_by", F.col("login"))))
    reasons = _reasons(
        (F.col("activity_trans_no").rlike(r"^[0-9]{1,10}$"), "bad task number"),
        (visible, "task is not visible to you"),
    )
    return checked.select(*requests.columns, reasons.alias("reasons"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)


def statement_reason(sql: Column | str, schema: str = K.VIEW_SCHEMA) -> Column:
    """Why a free-form statement is refused, or NULL; the first failing check decides."""
    text = F.col(sql) if isinstance(sql, str) else sql
    words = "|".join(K.FORBIDDEN_WORDS)
    prefixes = "|".join(K.FORBIDDEN_PREFIXES)
    lower = F.lower(text)
    with_names = F.regexp_extract_all(lower, F.lit(K.STATEMENT_WITH), F.lit(1))
    targets = F.regexp_extract_all(lower, F.lit(K.STATEMENT_TARGET), F.lit(1))
    unknown = F.filter(
        targets, lambda t: ~t.startswith(f"{schema}.") & ~F.array_contains(with_names, t)
    )
    first = F.try_element_at(unknown, F.lit(1))
    return F.coalesce(
        F.when(text.isNull() | ~text.rlike(r"(?U)\S"), K.STATEMENT_EMPTY),
        F.when(F.contains(text, F.lit(";")), K.STATEMENT_SEMICOLON),
        F.when(~lower.rlike(r"(?U)^\s*(select|with)\b"), K.STATEMENT_START),
        F.when(lower.rlike(rf"(?U)\b({words})\b|\b({prefixes})"), K.STATEMENT_FORBIDDEN),
        F.when(F.contains(text, F.lit("--")) | F.contains(text, F.lit("/*")), K.STATEMENT_COMMENT),
        F.when(
            first.isNotNull(),
            F.concat(F.lit("'"), first, F.lit(f"' is not allowed; only {schema}.* views (or CTEs) may be queried")),
        ),
    )


def statement_check(statements: DataFrame, column: str = "sql", schema: str = K.VIEW_SCHEMA) -> DataFrame:
    """Add ``reason`` to a table of statements (NULL: accepted)."""
    return statements.withColumn("reason", statement_reason(column, schema))
