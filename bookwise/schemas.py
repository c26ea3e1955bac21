"""Fixed schemas of the synced ERP tables and of the tables this package owns."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DateType(), T.BooleanType()
_TS, _MONEY, _QTY = T.TimestampType(), T.DecimalType(18, 2), T.DecimalType(18, 4)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CUSTOMERS = _struct(
    customer_id=_S, customer_name=_S, customer_class=_S, salesrep_id=_S, phys_address1=_S, phys_city=_S,
    phys_state=_S, phys_zip=_S, mail_city=_S, mail_zip=_S, phone=_S,
)
SALESREPS = _struct(id=_S, first_name=_S, last_name=_S)
INVOICE_SALES = _struct(
    invoice_no=_S, line_no=_I, order_no=_S, invoice_date=_D, ship_date=_D, customer_id=_S, customer_name=_S,
    salesrep_id=_S, taker=_S, item_id=_S, item_desc=_S, qty_shipped=_QTY, unit_price=_QTY, extended_price=_MONEY,
    product_group_id=_S, product_group_desc=_S, supplier_id=_S, supplier_name=_S, location_id=_S, county=_S,
    ship_city=_S, ship_state=_S, ship_zip=_S, other_charge_item=_S,
)
_ORDER_HEAD = dict(
    order_no=_S, line_no=_I, order_date=_D, customer_id=_S, customer_name=_S, salesrep_id=_S, taker=_S,
    customer_po=_S, item_id=_S, qty_ordered=_QTY,
)
_ORDER_TAIL = dict(
    product_group_id=_S, product_group_desc=_S, supplier_id=_S, supplier_name=_S, location_id=_S, county=_S,
    ship_city=_S, ship_state=_S, ship_zip=_S, date_last_modified=_TS,
)
OPEN_QUOTES = _struct(**_ORDER_HEAD, extended_price=_MONEY, **_ORDER_TAIL)
OPEN_ORDERS = _struct(**_ORDER_HEAD, qty_invoiced=_QTY, extended_price=_MONEY, **_ORDER_TAIL)
CANCELLED_QUOTES = _struct(
    **_ORDER_HEAD, extended_price=_MONEY, cancel_reason=_S, cancel_reason_desc=_S, **_ORDER_TAIL
)
ERP_USERS = _struct(id=_S, name=_S, email_address=_S)
ACTIVITY_TRANS = _struct(
    activity_trans_no=_S, activity_id=_S, contact_id=_S, entry_date=_D, assigned_by_id=_S, assigned_to_id=_S,
    completed_flag=_S, completed_date=_TS, completed_by_id=_S, subject=_S, comments=_S, target_complete_date=_TS,
    transaction_type_cd=_I, transaction_no=_S, link_type_cd=_I, link_id=_S, date_created=_TS, date_last_modified=_TS,
)
USER_ACCESS = _struct(
    login=_S, display_name=_S, role=_S, salesrep_id=_S, enabled=_B, notes=_S, updated_at=_TS, updated_by=_S
)
LIST_SETTINGS = _struct(key=_S, value=T.DecimalType(18, 4), note=_S)
TASK_TYPE = _struct(activity_id=_S, label=_S, sort=_I)
# Outbox ids are UUID strings: unique without a global sequence
TASK_OUTBOX = _struct(
    id=_S, created_at=_TS, created_by=_S, op=_S, activity_id=_S, customer_id=_S, assigned_to=_S, subject=_S,
    comments=_S, due_date=_D, transaction_type_cd=_I, transaction_no=_S, activity_trans_no=_S, status=_S,
    attempts=_I, error=_S, applied_at=_TS,
)
AUDIT_LOG = _struct(
    id=_S, ts=_TS, user_name=_S, session_id=_S, kind=_S, payload=_S, ms=_I, row_count=_I, dt=_D
)

TABLES = {
    "customers": CUSTOMERS,
    "salesreps": SALESREPS,
    "invoice_sales": INVOICE_SALES,
    "open_quotes": OPEN_QUOTES,
    "open_orders": OPEN_ORDERS,
    "cancelled_quotes": CANCELLED_QUOTES,
    "erp_users": ERP_USERS,
    "activity_trans": ACTIVITY_TRANS,
    "user_access": USER_ACCESS,
    "list_settings": LIST_SETTINGS,
    "task_type": TASK_TYPE,
    "task_outbox": TASK_OUTBOX,
}
FACTS = {
    "invoice_sales": "invoice_date",
    "open_quotes": "order_date",
    "open_orders": "order_date",
    "cancelled_quotes": "order_date",
}
