"""Map the generated star-schema tables onto the ERP tables.

The rules are deterministic and portable: ``plans/oracles.py`` states the same
mapping in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise import constants as K, schemas
from bookwise.sources.tables import Tables, conform

AS_OF = "2001-08-01"

# login, display name, role, salesrep id, enabled
ACCESS = [
    ("admin@example.com", "Ada Admin", "admin", None, True),
    ("manager@example.com", "Max Manager", "manager", None, True),
    ("rep3@example.com", None, "rep", "3", True),
    ("rep5@example.com", "Rae Five", "rep", "5", True),
    ("off@example.org", "Olga Off", "admin", None, False),
    ("list-service", "List service", "manager", None, True),
]
# id, name, email
USERS = [
    ("ADM", "ADA ADMIN", "admin@example.com"),
    ("MGR", "MAX MANAGER", "Manager@Example.COM"),
    ("R3", "RON THREE", "rep3@example.com"),
    ("R5", "RAE FIVE", "rep5@example.com"),
    ("OLD", "NO MAIL", None),
]


# schemas of the generated tables, so that reading needs no inference job
RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _key(name: str):
    return F.col(name).cast("string")


def _rep_id():
    return F.when(F.col("c_custkey") % 50 == 7, None).otherwise(_key("c_nationkey"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _read(spark, sf_dir, "region", "r_regionkey", "r_name")
    key = F.col("c_custkey")
    zip5 = F.lpad((F.col("c_nationkey") * 1000 + key % 1000).cast("string"), 5, "0")
    mapped = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _key("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.when(key % 8 == 0, None).otherwise(F.col("c_mktsegment")).alias("customer_class"),
            _rep_id().alias("salesrep_id"),
            F.when(key % 10 == 3, "  ").otherwise(F.concat(_key("c_custkey"), F.lit(" MAIN ST"))).alias("phys_address1"),
            F.col("n_name").alias("phys_city"),
            F.upper(F.substring("r_name", 1, 2)).alias("phys_state"),
            F.concat(zip5, F.lit("-1234")).alias("phys_zip"),
        )
    )
    return conform(mapped, "customers")


def salesreps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _read(spark, sf_dir, "region", "r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        _key("n_nationkey").alias("id"),
        F.col("n_name").alias("first_name"),
        F.when(F.col("n_nationkey") % 7 == 0, None).otherwise(F.col("r_name")).alias("last_name"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the columns that invoices and quotes share.

    Orders meet their customers before their lines, so that the lines, the longest
    table, are dealt out by order, part and supplier only.
    """
    lines = _read(
        spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = _read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_retailprice")
    supplier = _read(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    bought = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    credit = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 5), -1).otherwise(1)
    return (
        lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "*",
            _key("l_orderkey").alias("order_no"),
            F.col("l_linenumber").alias("line_no"),
            _key("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            _rep_id().alias("salesrep_id"),
            F.col("o_orderpriority").alias("taker"),
            _key("l_partkey").alias("item_id"),
            F.col("p_name").alias("item_desc"),
            F.col("p_brand").alias("product_group_id"),
            F.concat(F.lit("Group "), F.col("p_brand")).alias("product_group_desc"),
            _key("l_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            (F.col("l_extendedprice").cast("decimal(18,2)") * credit).cast("decimal(18,2)").alias("extended_price"),
        )
    )


def invoice_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("date")
    shipped = F.col("l_shipdate").cast("date")
    kept = (
        _lines(spark, sf_dir)
        .where(F.col("l_shipdate") <= as_of)
        .where(~((F.col("c_custkey") % 40 == 0) & (shipped < F.date_sub(as_of, 45))))
    )
    flag = F.when(F.col("l_linenumber") == 7, "Y").when(F.col("l_linenumber") == 6, None).otherwise("N")
    mapped = kept.withColumns(
        {
            "invoice_no": F.col("order_no"),
            "invoice_date": shipped,
            "ship_date": shipped,
            "qty_shipped": F.col("l_quantity"),
            "unit_price": F.col("p_retailprice"),
            "other_charge_item": flag,
        }
    )
    return conform(mapped, "invoice_sales")


def _order_table(spark: SparkSession, sf_dir: str, status: str, name: str) -> DataFrame:
    reason = F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("l_returnflag"))
    reason_desc = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.concat(F.lit("Reason "), F.col("l_returnflag")))
    mapped = (
        _lines(spark, sf_dir)
        .where(F.col("o_orderstatus") == status)
        .withColumns(
            {
                "order_date": F.col("o_orderdate").cast("date"),
                "customer_po": F.concat(F.lit("PO-"), _key("o_orderkey")),
                "qty_ordered": F.col("l_quantity"),
                "qty_invoiced": F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0),
                "cancel_reason": reason,
                "cancel_reason_desc": reason_desc,
            }
        )
    )
    return conform(mapped, name)


def activity_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an activity row, spread over the four ERP users."""
    events = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    key = F.col("event_id")

    def user(position):
        return F.element_at(F.array(*[F.lit(u[0]) for u in USERS[:4]]), (position % 4 + 1).cast("int"))

    due = F.date_add(F.lit(AS_OF).cast("date"), (key % 21 - 10).cast("int"))
    mapped = events.select(
        _key("event_id").alias("activity_trans_no"),
        F.lit("CUST_FU").alias("activity_id"),
        user(key).alias("assigned_to_id"),
        user(key + 1).alias("assigned_by_id"),
        F.when(key % 3 == 0, "Y").when(key % 11 == 0, None).otherwise("N").alias("completed_flag"),
        F.when(key % 6 == 0, None).otherwise(due).alias("target_complete_date"),
        F.when(key % 2 == 0, K.LINK_CUSTOMER).otherwise(1024).alias("link_type_cd"),
        _key("user_id").alias("link_id"),
        F.col("event_type").alias("subject"),
        F.col("ts").alias("date_created"),
    )
    return conform(mapped, "activity_trans")


def user_access(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ACCESS, "login string, display_name string, role string, salesrep_id string, enabled boolean")
    return conform(rows, "user_access")


def erp_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(USERS, schemas.ERP_USERS)


# op, status, created_by, assigned_to, due date, customer id
OUTBOX = [
    ("create", "pending", "rep3@example.com", "rep5@example.com", "2001-08-03", "12"),
    ("create", "processing", "rep3@example.com", "rep3@example.com", "2001-07-30", "13"),
    ("create", "failed", "manager@example.com", "rep3@example.com", None, "14"),
    ("create", "done", "admin@example.com", "rep5@example.com", "2001-08-09", "15"),
    ("create", "pending", "rep5@example.com", "nobody@example.com", "2001-08-05", "16"),
    ("complete", "pending", "rep3@example.com", None, None, None),
    ("complete", "done", "rep5@example.com", None, None, None),
]


def task_outbox(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(
        [(f"ob-{i}", *row) for i, row in enumerate(OUTBOX)],
        "id string, op string, status string, created_by string, assigned_to string, due_date string, customer_id string",
    )
    filled = rows.withColumns(
        {
            "created_at": F.lit("2001-07-31 09:00:00"),
            "activity_id": F.when(F.col("op") == "create", "CALL"),
            "subject": F.when(F.col("op") == "create", F.concat(F.lit("Call about "), "customer_id")),
            "activity_trans_no": F.when(F.col("op") == "complete", "40"),
            "attempts": F.lit(0),
        }
    )
    return conform(filled, "task_outbox")


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    settings = [(key, value, None) for key, value in K.LIST_SETTINGS.items()]
    return Tables(
        customers=lambda: customers(spark, sf_dir),
        salesreps=lambda: salesreps(spark, sf_dir),
        invoice_sales=lambda: invoice_sales(spark, sf_dir),
        open_quotes=lambda: _order_table(spark, sf_dir, "O", "open_quotes"),
        open_orders=lambda: _order_table(spark, sf_dir, "P", "open_orders"),
        cancelled_quotes=lambda: _order_table(spark, sf_dir, "F", "cancelled_quotes"),
        erp_users=lambda: erp_users(spark),
        activity_trans=lambda: activity_trans(spark, sf_dir),
        user_access=lambda: user_access(spark),
        list_settings=lambda: spark.createDataFrame(settings, schemas.LIST_SETTINGS),
        task_type=lambda: spark.createDataFrame(K.TASK_TYPES, schemas.TASK_TYPE),
        task_outbox=lambda: task_outbox(spark),
    )
