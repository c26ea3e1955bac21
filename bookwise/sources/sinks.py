"""Append logs, keyed-table updates and the JSON row export."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F, types as T

from bookwise import constants as K, schemas
from bookwise.functions.columns import top_rows

_log = logging.getLogger(__name__)


def audit_rows(events: DataFrame) -> DataFrame:
    """Shape (user_name, session_id, kind, payload struct, ms, row_count) as audit rows."""
    return events.select(
        F.uuid().alias("id"),
        F.current_timestamp().alias("ts"),
        "user_name",
        "session_id",
        "kind",
        F.to_json("payload", {"ignoreNullFields": "false"}).alias("payload"),
        F.col("ms").cast("int").alias("ms"),
        F.col("row_count").cast("int").alias("row_count"),
        F.current_date().alias("dt"),
    )


def append_audit(events: DataFrame, path: str) -> bool:
    """Append to the audit log, one directory per day. A failure is logged, never raised."""
    try:
        audit_rows(events).write.mode("append").partitionBy("dt").parquet(path)
        return True
    except Exception as error:  # the audited work must go on whatever broke here
        _log.warning("audit append failed: %s", error)
        return False


def outbox_creates(accepted: DataFrame) -> DataFrame:
    """Accepted create requests as outbox rows; an admin's test rows are marked and never applied.

    Optional input columns: activity_id, comments, transaction_type_cd,
    transaction_no, test (boolean), role.
    """

    def text(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit("")) if name in accepted.columns else F.lit(None).cast("string")

    flagged = {"test", "role"} <= set(accepted.columns)
    test = F.coalesce(F.col("test") & (F.col("role") == "admin"), F.lit(False)) if flagged else F.lit(False)
    due = F.try_to_date(F.nullif(F.trim("due_date"), F.lit("")), "yyyy-MM-dd")
    code = F.col("transaction_type_cd") if "transaction_type_cd" in accepted.columns else F.lit(None)
    return _outbox(
        accepted,
        created_by=F.lower(F.trim("created_by")),
        op=F.lit("create"),
        activity_id=F.coalesce(text("activity_id"), F.lit(K.DEFAULT_TASK_TYPE)),
        customer_id=F.trim("customer_id"),
        assigned_to=F.lower(F.trim("assigned_to")),
        subject=F.trim("subject"),
        comments=text("comments"),
        due_date=due,
        transaction_type_cd=code,
        transaction_no=text("transaction_no"),
        status=F.when(test, "failed").otherwise("pending"),
        attempts=F.when(test, 3).otherwise(0),
        error=F.when(test, "test row (never applied)"),
    )


def outbox_completes(accepted: DataFrame) -> DataFrame:
    """Accepted complete requests (login, activity_trans_no) as outbox rows."""
    return _outbox(
        accepted,
        created_by=F.col("login"),
        op=F.lit("complete"),
        activity_trans_no=F.col("activity_trans_no"),
        status=F.lit("pending"),
        attempts=F.lit(0),
    )


def _outbox(df: DataFrame, **columns: Column) -> DataFrame:
    columns = {"id": F.uuid(), "created_at": F.current_timestamp(), **columns}
    return df.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TASK_OUTBOX.fields]
    )


def append_outbox(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def folded(keys: list[str], fold: bool, df: DataFrame) -> DataFrame:
    """Keys as stored: lower case without outer blanks, if they are folded."""
    return df.withColumns({k: F.lower(F.trim(k)) for k in keys}) if fold else df


def upsert(
    current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column], stamps: dict[str, Column], fold: bool = False
) -> DataFrame:
    """Insert or replace by key: the latest change of a key wins over the stored row.

    ``order`` ranks the changes of one key (first wins) and ``stamps`` sets columns on
    changed rows. ``fold`` compares and stores text keys in lower case, trimmed, on
    both sides; stored rows that only case tells apart then fold to the one that
    sorts first. Changes collapse to one per key before they meet the table, so a
    key changed a billion times is still one row, and unchanged rows only pass a
    join. Write the result to a new path.
    """
    if fold:
        everything = [F.col(c) for c in current.columns]
        current = top_rows(folded(keys, True, current), keys, everything, 1)
    latest = top_rows(folded(keys, fold, changes), keys, order, 1).withColumns(stamps).select(*current.columns)
    kept = current.join(latest.select(*keys), keys, "left_anti")
    return kept.select(*current.columns).unionByName(latest)


def seed_if_absent(current: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Add the seeds whose key is not stored yet; stored rows stay as they are.

    Of several seeds of one key the one whose columns sort first is added.
    """
    first = top_rows(seeds.select(*current.columns), keys, [F.col(c) for c in current.columns], 1)
    new = first.join(current.select(*keys), keys, "left_anti")
    return current.unionByName(new.select(*current.columns))


def usable_renames(current: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """(old, new, usable): the renames that keep the key unique, and those that do not.

    A rename is usable if its old key is stored, its new key is not, no smaller new
    key is asked for the same old one, and no smaller old key asks for the same new one.
    """
    asked = mapping.select("old", "new").where("old IS NOT NULL AND new IS NOT NULL").distinct()
    stored = current.select(F.col(key).alias("old")).distinct()
    free = asked.join(stored, "old", "left_semi").join(stored.select(F.col("old").alias("new")), "new", "left_anti")
    single = top_rows(free, ["old"], [F.col("new").asc()], 1)
    single = top_rows(single.select("old", "new"), ["new"], [F.col("old").asc()], 1)
    chosen = single.select("old", "new", F.lit(True).alias("chosen"))
    return asked.join(chosen, ["old", "new"], "left").select("old", "new", F.coalesce("chosen", F.lit(False)).alias("usable"))


def key_remap(current: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Rename keys by (old, new) pairs, as far as ``usable_renames`` allows; all other rows stay."""
    good = usable_renames(current, mapping, key).where("usable").select(F.col("old").alias(key), F.col("new").alias("_new"))
    renamed = current.join(good, key, "left")
    return renamed.withColumn(key, F.coalesce("_new", key)).select(*current.columns)


def json_rows(df: DataFrame, max_rows: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows as JSON text: dates as yyyy-MM-dd, decimals on two places half-even, NULLs kept."""
    if order:
        df = df.orderBy(*order)
    if max_rows is not None:
        df = df.limit(max_rows)

    def shaped(field: T.StructField) -> Column:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            col = F.bround(col, 2) if field.dataType.scale > 2 else col
        return col.alias(field.name)

    row = F.struct(*[shaped(f) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))
