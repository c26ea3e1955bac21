"""Row-level scoping: which customers a login may see, and the login directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookwise.context import Scope
from bookwise.functions.columns import full_name


def scope_customer(customers: DataFrame, scope: Scope) -> DataFrame:
    """Visible customer ids. Fails closed: a NULL rep id never equals a rep."""
    ids = customers.select("customer_id", "salesrep_id")
    if scope.sees_all:
        return ids.select("customer_id")
    if scope.my_rep is None:
        return ids.where(F.lit(False)).select("customer_id")
    return ids.where(F.col("salesrep_id") == scope.my_rep).select("customer_id")


def scoped(df: DataFrame, customers: DataFrame, scope: Scope) -> DataFrame:
    """Rows of visible customers only.

    Apply it before aggregating for a rep (a small book prunes the scan) and after
    aggregating for a login that sees all; both give the same rows because every
    scoped dataset is keyed by customer.
    """
    return df.join(scope_customer(customers, scope), "customer_id", "left_semi")


def enabled_logins(user_access: DataFrame) -> DataFrame:
    """One row per enabled login with its scope key: '*' (all) or the rep id."""
    all_accounts = F.col("role").isin("manager", "admin")
    return user_access.where("enabled").select(
        "login",
        "display_name",
        "role",
        "salesrep_id",
        all_accounts.alias("sees_all"),
        F.when(all_accounts, "*").when(F.col("role") == "rep", F.concat(F.lit("rep:"), "salesrep_id")).alias("scope_key"),
    )


def people(user_access: DataFrame, erp_user: DataFrame) -> DataFrame:
    """Enabled mail logins that have an ERP user, with the name to show."""
    return (
        user_access.where(F.col("enabled") & F.col("login").like("%@%"))
        .join(erp_user, "login")
        .select("login", F.coalesce("display_name", "name").alias("name"), "role", "erp_user_id")
    )


def login_directory(
    user_access: DataFrame, customers: DataFrame, salesreps: DataFrame, erp_user: DataFrame
) -> DataFrame:
    """Every enabled login with rep name, scope text and ERP user, in one pass.

    The rep name shows only if the login sees a customer of that rep, so it is
    taken over the reps that occur on customers.
    """
    logins = enabled_logins(user_access)
    with_customers = customers.select("salesrep_id").where("salesrep_id IS NOT NULL").distinct()
    names = (
        salesreps.select(F.col("id").alias("salesrep_id"), full_name("first_name", "last_name").alias("rep_name"))
        .join(with_customers, "salesrep_id", "left_semi")
        .groupBy("salesrep_id")
        .agg(F.max("rep_name").alias("salesrep_name"))
    )
    assigned = F.coalesce("salesrep_name", F.concat(F.lit("rep "), "salesrep_id"))
    text = F.when(F.col("sees_all"), "all accounts").otherwise(F.concat(F.lit("accounts assigned to "), assigned))
    return (
        logins.join(names, "salesrep_id", "left")
        .join(erp_user, "login", "left")
        .select(
            "login",
            F.coalesce("display_name", "name").alias("display_name"),
            "role",
            "salesrep_id",
            "salesrep_name",
            text.alias("scope_text"),
            "erp_user_id",
            (F.col("login").like("%@%") & F.col("erp_user_id").isNotNull()).alias("is_person"),
        )
    )
