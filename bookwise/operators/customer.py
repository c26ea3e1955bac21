"""Per-customer reports for a set of subjects: one customer is the one-row case."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookwise import constants as K
from bookwise.context import as_of_column, months_before
from bookwise.functions.columns import clamp, distinct_values, restrict, top_rows
from bookwise.functions.contains import matching_literal, matching_wildcards, piece_index
from bookwise.sources.tables import since


def account_figures(pg12: DataFrame, ltd: DataFrame) -> DataFrame:
    """12-month sales and last invoice day per customer, from the two rollups."""
    year = pg12.groupBy("customer_id").agg(F.sum("sales_12m").alias("year_sales"))
    last = ltd.groupBy("customer_id").agg(F.max("last_invoice_date").alias("last_invoice"))
    return last.join(year, "customer_id", "left")


def with_figures(customers: DataFrame, figures: DataFrame) -> DataFrame:
    sales = F.round(F.coalesce("year_sales", F.lit(0).cast("decimal(38,2)")), 0)
    return customers.join(figures, "customer_id", "left").withColumn("sales_12m", sales).drop("year_sales")


def customer_snapshot(
    customer_dim: DataFrame,
    sales: DataFrame,
    open_quotes: DataFrame,
    open_orders: DataFrame,
    pg12: DataFrame,
    subjects: DataFrame | None,
    as_of=None,
) -> DataFrame:
    """Profile, sales totals, pending documents and the top groups of each subject.

    Lines count with other charges included; the groups come from the rollup.
    """
    year, before = months_before(as_of, 12), months_before(as_of, 24)
    recent = F.col("invoice_date") >= year
    prior = (F.col("invoice_date") >= before) & (F.col("invoice_date") < year)
    price = F.col("extended_price")
    totals = (
        restrict(sales, subjects)
        .groupBy("customer_id")
        .agg(
            F.round(F.sum(F.when(recent, price)), 0).alias("sales_12m"),
            F.round(F.sum(F.when(prior, price)), 0).alias("sales_prior_12m"),
            F.round(F.sum(price), 0).alias("sales_lifetime"),
            F.countDistinct(F.when(recent, F.col("invoice_no"))).alias("invoices_12m"),
            F.max("invoice_date").alias("last_invoice_date"),
            F.min("invoice_date").alias("first_invoice_date"),
        )
    )
    quotes = (
        restrict(since(open_quotes, "order_date", F.date_sub(as_of_column(as_of), 180)), subjects)
        .groupBy("customer_id")
        .agg(
            F.countDistinct("order_no").alias("open_quotes_180d"),
            F.round(F.sum(price), 0).alias("open_quote_value_180d"),
        )
    )
    orders = (
        restrict(open_orders, subjects)
        .groupBy("customer_id")
        .agg(F.countDistinct("order_no").alias("open_orders"), F.round(F.sum(price), 0).alias("open_order_value"))
    )
    order = [F.col("sales_12m").desc_nulls_first(), F.col("product_group_id").asc_nulls_last()]
    best = top_rows(restrict(pg12, subjects), ["customer_id"], order, K.TOP_GROUPS, rank="rank")
    entry = F.struct(
        "rank",
        F.col("product_group_desc").alias("product_group"),
        F.round("sales_12m", 0).alias("sales_12m"),
        F.col("last_invoice_date").alias("last"),
    )
    groups = best.groupBy("customer_id").agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
    zero_money, zero = F.lit(0).cast("decimal(28,0)"), F.lit(0).cast("bigint")
    return (
        restrict(customer_dim, subjects)
        .select("customer_id", "customer_name", "customer_class", "salesrep_name")
        .join(totals, "customer_id", "left")
        .join(quotes, "customer_id", "left")
        .join(orders, "customer_id", "left")
        .join(groups, "customer_id", "left")
        .select(
            "customer_id", "customer_name", "customer_class", "salesrep_name",
            "sales_12m", "sales_prior_12m", "sales_lifetime",
            F.coalesce("invoices_12m", zero).alias("invoices_12m"),
            "last_invoice_date", "first_invoice_date",
            F.coalesce("open_quotes_180d", zero).alias("open_quotes_180d"),
            F.coalesce("open_quote_value_180d", zero_money).alias("open_quote_value_180d"),
            F.coalesce("open_orders", zero).alias("open_orders"),
            F.coalesce("open_order_value", zero_money).alias("open_order_value"),
            # no groups at all: NULL, not an empty list
            F.transform("ranked", lambda x: x.dropFields("rank")).alias("top_groups"),
        )
    )


def recent_activity(sales: DataFrame, subjects: DataFrame | None, months: int | None = None, as_of=None) -> DataFrame:
    """Newest 40 invoices per subject with total, lines, top items and groups."""
    months = clamp(months, 6, 1, 60)
    lines = restrict(since(sales, "invoice_date", months_before(as_of, months)), subjects)
    keys = ["customer_id", "invoice_no", "invoice_date"]
    invoices = lines.groupBy(*keys).agg(
        F.min("order_no").alias("order_no"),
        F.round(F.sum("extended_price"), 0).alias("invoice_total"),
        F.count(F.lit(1)).alias("lines"),
        F.max("taker").alias("taker"),
        F.max("ship_city").alias("ship_city"),
        distinct_values("product_group_desc").alias("product_groups"),
    )
    newest = top_rows(invoices, ["customer_id"], [F.col("invoice_date").desc(), F.col("invoice_no").asc()], K.TOOL_ROWS)
    # four lines per invoice survive the ranking, so an invoice of any size is one short list
    by_price = [F.col("extended_price").desc_nulls_first(), F.col("item_desc").asc_nulls_last()]
    dearest = top_rows(lines.select(*keys, "item_desc", "extended_price"), keys, by_price, K.TOP_ITEMS, rank="rank")
    items = dearest.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_desc"))), lambda x: x["item_desc"]).alias("top_items")
    )
    return newest.join(items, keys, "left").select(
        "customer_id", "invoice_no", "order_no", "invoice_date", "invoice_total", "lines", "taker", "ship_city",
        "top_items", "product_groups",
    )


def open_quotes(quotes: DataFrame, subjects: DataFrame | None, max_age_days: int | None = None, as_of=None) -> DataFrame:
    """Open quotes of each subject, the 40 biggest first."""
    days = clamp(max_age_days, 180, 1, 3650)
    lines = restrict(since(quotes, "order_date", F.date_sub(as_of_column(as_of), days)), subjects)
    grouped = lines.groupBy("customer_id", "order_no").agg(
        F.min("order_date").alias("quote_date"),
        F.round(F.sum("extended_price"), 0).alias("quote_value"),
        F.count(F.lit(1)).alias("lines"),
        F.max("taker").alias("taker"),
        F.max("customer_po").alias("customer_po"),
        distinct_values("product_group_desc").alias("product_groups"),
    )
    best = top_rows(
        grouped, ["customer_id"], [F.col("quote_value").desc_nulls_first(), F.col("order_no").asc()], K.TOOL_ROWS
    )
    age = F.datediff(as_of_column(as_of), F.col("quote_date"))
    return best.select(
        "customer_id", "order_no", "quote_date", age.alias("age_days"), "quote_value", "lines", "taker",
        "customer_po", "product_groups",
    )


def cancelled_quotes(quotes: DataFrame, subjects: DataFrame | None, months: int | None = None, as_of=None) -> DataFrame:
    """Cancelled quotes of each subject by reason."""
    months = clamp(months, 12, 1, 60)
    lines = restrict(since(quotes, "order_date", months_before(as_of, months)), subjects)
    reason = F.coalesce("cancel_reason_desc", "cancel_reason", F.lit("(no reason)"))
    grouped = (
        lines.withColumn("reason", reason)
        .groupBy("customer_id", "reason")
        .agg(
            F.countDistinct("order_no").alias("quotes"),
            F.round(F.sum("extended_price"), 0).alias("value"),
            F.max("order_date").alias("most_recent"),
            distinct_values("product_group_desc").alias("product_groups"),
        )
    )
    return top_rows(grouped, ["customer_id"], [F.col("value").desc_nulls_first(), F.col("reason").asc()], K.TOOL_ROWS)


def customers_near(
    customer_dim: DataFrame, figures: DataFrame, places: DataFrame, limit: int | None = None
) -> DataFrame:
    """Customers near each place: 5-digit zip, two-letter state, else a town.

    ``places`` is (place, exclude_customer_id). Zip areas and states are equi-joins.
    A town is a LIKE pattern: without wildcards it is an equality on the lower-cased
    town, and a pattern meets the distinct towns only, never the customers. Customers
    are ranked once per area, before any place is asked for: a state that holds a
    third of them gives each place limit + 1 rows.
    """
    limit = clamp(limit, K.NEAR_ROWS, 1, 100)
    asked = places.select(
        F.trim("place").alias("place"), F.trim(F.coalesce("exclude_customer_id", F.lit(""))).alias("excluded")
    ).distinct()
    kind = (
        F.when(F.col("place").rlike(r"^[0-9]{5}$"), "zip")
        .when(F.col("place").rlike(r"^[A-Za-z]{2}$"), "state")
        .when(F.col("place").rlike(r"[%_\\]"), "pattern")
        .otherwise("town")
    )
    key = (
        F.when(F.col("kind") == "zip", F.left("place", F.lit(3)))
        .when(F.col("kind") == "state", F.upper("place"))
        .otherwise(F.lower("place"))
    )
    asked = asked.withColumn("kind", kind).withColumn("key", key)
    areas = F.array(
        F.struct(F.lit("zip").alias("kind"), F.left("zip", F.lit(3)).alias("key")),
        F.struct(F.lit("state").alias("kind"), F.upper("state").alias("key")),
        F.struct(F.lit("town").alias("kind"), F.lower("city").alias("key")),
    )
    slim = with_figures(customer_dim.select("customer_id", "zip", "state", "city"), figures)
    keyed = slim.select("customer_id", "zip", "sales_12m", "last_invoice", F.inline(areas))
    order = [
        F.col("sales_12m").desc_nulls_last(), F.col("last_invoice").desc_nulls_last(), F.col("customer_id").asc(),
    ]
    # A place leaves out one customer at most, so limit + 1 customers of an area answer every place in it.
    leading = top_rows(keyed, ["kind", "key"], order, limit + 1)
    towns = piece_index(customer_dim.select(F.lower("city").alias("town")), "town")
    patterns = asked.where("kind = 'pattern'").withColumnRenamed("place", "query")
    # the index finds towns that contain the pattern; the pattern has to cover the whole town
    near = matching_literal(towns, patterns.select("query").distinct()).unionByName(matching_wildcards(towns, patterns.select("query").distinct()))
    meant = (
        patterns.join(near.distinct(), "query").where(F.expr("text ILIKE query"))
        .select(F.col("query").alias("place"), "excluded", F.lit("town").alias("kind"), F.col("text").alias("key"))
    )
    wanted = asked.where("kind <> 'pattern'").unionByName(meant)
    found = leading.join(wanted, ["kind", "key"]).where("customer_id <> excluded")
    how = F.when(F.col("kind") == "zip", F.when(F.col("zip") == F.col("place"), "same zip").otherwise("nearby zip"))
    best = top_rows(found.withColumn("how", F.coalesce(how, F.lit("match"))), ["place", "excluded"], order, limit)
    named = best.drop("zip", "kind", "key").join(customer_dim, "customer_id")
    return named.select(
        "place", "customer_id", "customer_name", "customer_class", "salesrep_name", "address", "city", "state", "zip",
        "phone", "sales_12m", "last_invoice", "how",
    )


def vocabulary(customer_dim: DataFrame, pg12: DataFrame, penetration: DataFrame) -> DataFrame:
    """Two rows: names of the biggest customers and all common product groups, cleaned.

    The names are cut to their report size before they are gathered; the groups are
    a dimension's values.
    """
    totals = pg12.groupBy("customer_id").agg(F.sum("sales_12m").alias("sales"))
    by_name = customer_dim.join(totals, "customer_id").groupBy("customer_name").agg(F.sum("sales").alias("sales"))
    ranked = by_name.orderBy(F.col("sales").desc_nulls_first(), F.col("customer_name").asc()).limit(K.VOCABULARY_NAMES)
    names = ranked.select(
        F.lit("customers").alias("list"), (-F.col("sales")).cast("double").alias("place"), F.col("customer_name").alias("word")
    )
    common = penetration.where(F.col("penetration_pct") >= K.VOCABULARY_MIN_PCT)
    groups = common.select(F.col("product_group_desc").alias("word")).distinct()
    words = names.unionByName(groups.select(F.lit("products").alias("list"), F.lit(0.0).alias("place"), "word"))
    clean = F.trim(F.regexp_replace("word", "[^A-Za-z0-9&' .-]", " "))
    listed = words.where("length(word) > 0").withColumn("clean", clean)
    ordered = F.array_sort(F.collect_list(F.struct("place", "word", "clean")))
    return listed.groupBy("list").agg(
        F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["clean"])), ", ").alias("words")
    )
