"""The five triggers behind the week list. Inputs are scoped or whole; both work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookwise.context import Settings, as_of_column, months_before
from bookwise.functions.columns import distinct_non_null, not_other_charge
from bookwise.sources.tables import since


def _age(as_of, day: str) -> Column:
    return F.datediff(as_of_column(as_of), F.col(day))


def stale_quotes(open_quotes: DataFrame, settings: Settings, as_of=None) -> DataFrame:
    """Open quotes inside the age band and worth a call, one row per quote."""
    today = as_of_column(as_of)
    oldest = F.date_sub(today, settings.days("quote_max_age_days"))
    newest = F.date_sub(today, settings.days("quote_min_age_days"))
    # the band filters lines, before grouping
    lines = since(open_quotes, "order_date", oldest).where(F.col("order_date") <= newest)
    quotes = lines.groupBy("customer_id", "order_no").agg(
        F.max("customer_name").alias("customer_name"),
        F.min("order_date").alias("quote_date"),
        F.sum("extended_price").alias("value"),
        F.count(F.lit(1)).alias("lines"),
        F.max("taker").alias("taker"),
        F.max("customer_po").alias("customer_po"),
        distinct_non_null("product_group_desc").alias("product_groups"),
    )
    return quotes.where(F.col("value") >= settings.column("quote_min_value")).select(
        "customer_id", "customer_name", "order_no", "quote_date", _age(as_of, "quote_date").alias("age_days"),
        F.round("value", 0).alias("quote_value"), "lines", "taker", "customer_po", "product_groups",
    )


def _with_gap(days: DataFrame, keys: list[str]) -> DataFrame:
    """Days since the previous invoice day. A group has one row per day, never per line."""
    order = Window.partitionBy(*keys).orderBy("invoice_date")
    return days.withColumn("gap", F.datediff("invoice_date", F.lag("invoice_date").over(order)))


def going_quiet(sales: DataFrame, settings: Settings, as_of=None) -> DataFrame:
    """Accounts silent for longer than their own usual gap between invoice days.

    Lines collapse to (customer, name, day) by hashing on the map side, so the window
    sees at most 24 months of days per customer. The short result is partitioned by
    customer once, for the days, the window and the cadence.
    """
    year = F.col("invoice_date") >= months_before(as_of, 12)
    days = (
        since(sales, "invoice_date", months_before(as_of, 24))
        .groupBy("customer_id", "customer_name", "invoice_date")
        .agg(F.sum(F.when(year & not_other_charge(), F.col("extended_price"))).alias("sales"))
        .repartition("customer_id")
        .groupBy("customer_id", "invoice_date")
        .agg(F.max("customer_name").alias("customer_name"), F.sum("sales").alias("sales"))
    )
    cadence = (
        _with_gap(days, ["customer_id"])
        .groupBy("customer_id")
        .agg(
            F.max("customer_name").alias("customer_name"),
            F.count_if(year).alias("invoice_days_12m"),
            F.percentile("gap", F.lit(0.5)).alias("med_gap"),
            F.max("invoice_date").alias("last_invoice"),
            F.sum("sales").alias("sales"),
        )
    )
    silent = _age(as_of, "last_invoice")
    overdue = F.greatest(
        settings.column("quiet_min_days"), F.col("med_gap") * settings.column("quiet_overdue_factor")
    )
    return cadence.where(
        (F.col("invoice_days_12m") >= settings.column("quiet_min_invoices_12m"))
        & (silent >= overdue)
        & (silent <= settings.column("quiet_max_days"))
    ).select(
        "customer_id", "customer_name", "last_invoice", silent.alias("days_silent"),
        F.round("med_gap", 0).alias("usual_gap_days"), "invoice_days_12m",
        F.round(F.coalesce("sales", F.lit(0).cast("decimal(28,2)")), 0).alias("sales_12m"),
    )


def reorder_due(sales: DataFrame, settings: Settings, as_of=None) -> DataFrame:
    """The same cadence per customer and product group, with a lower and an upper bound."""
    keys = ["customer_id", "product_group_id"]
    year = F.col("invoice_date") >= months_before(as_of, 12)
    days = (
        since(sales, "invoice_date", months_before(as_of, 24))
        .where("product_group_id IS NOT NULL")
        .groupBy(*keys, "customer_name", "product_group_desc", "invoice_date")
        .agg(F.sum("extended_price").alias("value"))
        .repartition(*keys)
        .groupBy(*keys, "invoice_date")
        .agg(
            F.max("customer_name").alias("customer_name"),
            F.max("product_group_desc").alias("product_group_desc"),
            F.sum("value").alias("value"),
        )
    )
    cadence = (
        _with_gap(days, keys)
        .groupBy(*keys)
        .agg(
            F.max("customer_name").alias("customer_name"),
            F.max("product_group_desc").alias("product_group_desc"),
            F.count(F.lit(1)).alias("buy_days"),
            F.percentile("gap", F.lit(0.5)).alias("med_gap"),
            F.max("invoice_date").alias("last_buy"),
            F.coalesce(F.sum(F.when(year, F.col("value"))), F.lit(0).cast("decimal(28,2)")).alias("sales"),
        )
    )
    since_buy = _age(as_of, "last_buy")
    usual = F.col("med_gap")
    overdue = F.greatest(settings.column("reorder_min_days"), usual * settings.column("reorder_overdue_factor"))
    return cadence.where(
        (F.col("buy_days") >= settings.column("reorder_min_orders"))
        & (F.col("sales") >= settings.column("reorder_min_value_12m"))
        & (since_buy >= overdue)
        & (since_buy <= usual * settings.column("reorder_dead_factor"))
    ).select(
        "customer_id", "customer_name", "product_group_id", "product_group_desc", "last_buy",
        since_buy.alias("days_since"), F.round("med_gap", 0).alias("usual_gap_days"),
        F.round("sales", 0).alias("sales_12m"), "buy_days",
    )


def new_accounts(sales: DataFrame, settings: Settings, as_of=None, history: DataFrame | None = None) -> DataFrame:
    """Accounts whose first invoice falls inside the last N days.

    All lines of a new account are recent, so the whole history is read for two
    columns only (first day per customer; from ``history`` if a compacted table is at
    hand) and the details come from the recent partitions.
    """
    history = sales if history is None else history
    first_day = F.date_sub(as_of_column(as_of), settings.days("new_account_days"))
    newcomers = (
        history.groupBy("customer_id")
        .agg(F.min("invoice_date").alias("first_invoice"))
        .where(F.col("first_invoice") >= first_day)
        .select("customer_id")
    )
    accounts = (
        since(sales, "invoice_date", first_day)
        .join(newcomers, "customer_id", "left_semi")
        .groupBy("customer_id")
        .agg(
            F.max("customer_name").alias("customer_name"),
            F.min("invoice_date").alias("first_invoice"),
            F.sum("extended_price").alias("sales"),
            F.countDistinct("invoice_no").alias("invoices"),
            distinct_non_null("product_group_desc").alias("product_groups"),
        )
    )
    return accounts.select(
        "customer_id", "customer_name", "first_invoice", _age(as_of, "first_invoice").alias("days_ago"),
        F.round("sales", 0).alias("sales_to_date"), "invoices", "product_groups",
    )
