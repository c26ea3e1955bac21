"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bookwise.functions.staging import stage
from bookwise.llm.common import frequent, lookup


def _split_lookup(df: DataFrame, other: DataFrame, key: str, often: DataFrame) -> DataFrame:
    """Inner join on ``key``; keys in the staged table ``often`` stay out of the shuffle, where there are any."""
    return lookup(df, other, key, often) if often.limit(1).count() else df.join(other, key)


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Each round gives a node the smallest label around it and then the label of that
    label, so chains halve and rounds grow with the logarithm of the longest one.
    Every round is a written table: no lineage grows and a lost executor costs
    nothing but its tasks. Hubs and labels that many nodes carry are met by a
    bounded broadcast and minima combine before their shuffle, so no node and no
    component fills a task. Self-links and repeated edges do no harm; null ends are dropped.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = stage(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    rows = both.count()
    hubs = stage(frequent(both, "v", rows), "cc-hubs")
    labels = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "cc-labels")
    while True:
        near = _split_lookup(both, labels.select(F.col("u").alias("v"), "label"), "v", hubs).groupBy("u").agg(F.min("label").alias("near"))
        lower = stage(labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-lower")
        jump = lower.select(F.col("u").alias("label"), F.col("label").alias("further"))
        new = _split_lookup(lower, jump, "label", stage(frequent(lower, "label", rows), "cc-often"))
        new = stage(new.select("u", "old", F.least("label", "further").alias("label")), "cc-labels")
        labels = new.select("u", "label")
        if new.where("old <> label").limit(1).count() == 0:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
