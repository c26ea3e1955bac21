"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.common import hash_order, part_of, ranked, small, table, text_or_empty, twins
from bookwise.llm.draws import communication_matrix, even

SHARDS = 24
#: Source partitions of the matrix; the driver holds BLOCKS * SHARDS counts.
BLOCKS = 256
SEED = 20_24


def shard_rows(df: DataFrame, n_shards: int = SHARDS, n_blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    1. Rows are dealt to source blocks by a hash of all their columns.
    2. The driver reads the block sizes and draws the communication matrix: how
       many rows each block sends to each shard if all rows were permuted at once.
       Shard sizes are fixed beforehand and differ by one at most.
    3. Each block permutes its rows and cuts them by its row of the matrix.
    4. Each shard permutes what it received.

    Pass narrow rows (an id and what identifies the content) and join the rest by
    them. Null values are values; equal rows are interchangeable and each is
    placed; an empty table gives no rows. The result depends on the rows, the seed
    and the parameters alone. Columns ``shard`` and ``slot`` of ``df`` are refused.
    """
    if {"shard", "slot"} & set(df.columns):
        raise ValueError("shard and slot are columns of the result")
    columns = df.columns
    keyed = twins(df).select(F.struct(*columns).alias("row"), "twin")
    for k, name in enumerate(("block", "send", "send2", "place", "place2")):
        keyed = keyed.withColumn(name, F.xxhash64(F.lit(seed + k), "row", "twin"))
    rows = stage(keyed.withColumn("block", F.pmod("block", F.lit(n_blocks)).cast("int")), "shard-rows")
    spark = df.sparkSession
    counts = dict(rows.groupBy("block").count().collect())
    sizes = [counts.get(b, 0) for b in range(n_blocks)]
    matrix = communication_matrix(np.random.default_rng(seed), sizes, even(sum(sizes), n_shards))
    ends = spark.createDataFrame(
        [(b, [int(x) for x in np.cumsum(matrix[b])]) for b in range(n_blocks)], "block int, ends array<long>"
    )
    local = ranked(rows, ["block"], ["send", "send2"], groups=n_blocks, bits=4)
    sent = local.join(small(ends, n_blocks), "block").withColumn("shard", part_of(F.col("ends"), F.col("rank")))
    sent = sent.select("row", "shard", "place", "place2")
    return ranked(sent, ["shard"], ["place", "place2"], groups=n_shards, rank="slot").select("row.*", "shard", "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts are at most one apart."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", text_or_empty("text"))
    slim = docs.select(
        "doc_id",
        (F.octet_length("text") + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    return shard_rows(slim).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
