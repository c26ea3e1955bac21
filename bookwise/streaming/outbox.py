"""Task requests arriving as files: check each batch, append what passes, keep what fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bookwise.operators import validate
from bookwise.sources import sinks

CREATE_REQUEST = (
    "request_id string, session_login string, created_by string, assigned_to string, customer_id string, "
    "subject string, comments string, activity_id string, due_date string, transaction_type_cd int, "
    "transaction_no string, role string, test boolean"
)
#: Requests that say when they were sent, so that repeats and late ones are told by event time.
TIMED_CREATE_REQUEST = CREATE_REQUEST + ", sent_at timestamp"
TOO_LATE = "the request arrived too late"
#: Groups of requests that share a piece of state.
GROUPS = 4_096

COMPLETE_REQUEST = "login string, activity_trans_no string"


def request_stream(spark: SparkSession, path: str, max_files: int = 1000, schema: str = CREATE_REQUEST) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def once_by_event_time(requests: DataFrame, delay: str) -> DataFrame:
    """Each request once, with ``late``: it was sent before the watermark, ``delay`` behind the newest request.

    A request is known by its request_id, without one by all it says. The first row
    of a request passes and is remembered until the watermark has passed its
    sent_at; repeats within that time go, in whatever file or batch they arrive.
    After that a repeat is late like any other old row: late rows pass with
    ``late`` set, so that they can be kept as rejects. Rows that do not say when they
    were sent are late. Requests are remembered in GROUPS groups by their hash; a
    group forgets what the watermark has passed whenever it gets rows, so the state
    holds about the requests of one delay.
    """
    columns = list(requests.columns)
    schema = T.StructType([*requests.schema.fields, T.StructField("late", T.BooleanType())])
    key = F.coalesce("request_id", F.concat(F.lit("content "), F.sha2(F.to_json(F.struct(*columns)), 256)))
    timed = requests.withColumn("_key", key).withWatermark("sent_at", delay)
    timed = timed.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(GROUPS)))

    def first(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = {k: t for k, t in zip(*state.get) if t >= watermark} if state.exists else {}
        for batch in batches:
            batch = batch.sort_values("sent_at", kind="stable")
            sent = batch["sent_at"].astype("datetime64[ms]").astype("int64").where(batch["sent_at"].notna(), -1)
            late = sent < max(watermark, 0)
            passed = []
            for name, at, old in zip(batch["_key"], sent, late):
                passed.append(old or name not in known)
                if not old:
                    known.setdefault(name, int(at))
            yield batch[columns].assign(late=late)[passed]
        state.update((list(known), list(known.values())))

    grouped = timed.groupBy("_group")
    return grouped.applyInPandasWithState(first, schema, "ids array<string>, sent array<long>", "append", GroupStateTimeout.NoTimeout)


def _ingest(
    requests: DataFrame, check: Callable[[DataFrame], DataFrame], rows: Callable[[DataFrame], DataFrame],
    outbox: str, rejects: str, checkpoint: str,
) -> StreamingQuery:
    """Start the ingest; each run takes what has arrived and stops.

    A batch replayed after a failure overwrites its own directory, so no request is
    appended twice. The checks of a batch run once, for both of its writes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        timed = "late" in batch.columns
        known = batch.persist() if timed else batch
        checked = check(known.where("NOT late").drop("late") if timed else known).persist()
        try:
            rows(validate.accepted(checked)).write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
            refused = validate.rejected(checked)
            if timed:
                late = known.where("late").drop("late").withColumn("reasons", F.array(F.lit(TOO_LATE)))
                refused = refused.unionByName(late)
            refused.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            checked.unpersist()
            known.unpersist()

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_creates(
    requests: DataFrame, user_access: DataFrame, erp_user: DataFrame, outbox: str, rejects: str, checkpoint: str, delay: str | None = None
) -> StreamingQuery:
    """Task-create requests; with ``delay`` (they have ``sent_at``) each once, and late ones to the rejects."""
    if delay is not None:
        requests = once_by_event_time(requests, delay)
    return _ingest(
        requests, lambda batch: validate.task_create_check(batch, user_access, erp_user), sinks.outbox_creates, outbox, rejects, checkpoint
    )


def ingest_completes(
    requests: DataFrame, all_tasks: DataFrame, logins: DataFrame, outbox: str, rejects: str, checkpoint: str
) -> StreamingQuery:
    """Task-complete requests (login, activity_trans_no); a task must be visible to the login."""
    return _ingest(
        requests, lambda batch: validate.task_complete_check(batch, all_tasks, logins), sinks.outbox_completes, outbox, rejects, checkpoint
    )
