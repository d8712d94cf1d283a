"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caudal.llm.common import stored

# Rows that a slice of a key is meant to have.
SLICE = 512


def join_dealt(
    rows: DataFrame, key: str, by: str, unique: DataFrame, slices: int, how: str = "inner"
) -> DataFrame:
    """``rows``, a stored table, joined with ``unique``, which has one row per ``key``, however many
    rows share one key.

    Rows are dealt by key and a hash of ``by`` over ``slices``, as many as the table has rows for;
    a row of ``unique`` is copied to the slices that its key has rows in. No key is a task of its
    own, and the copies are at most as many as the rows.
    """
    if slices <= 1:
        return rows.join(unique, key, how)
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(by), F.lit(slices)))
    copies = dealt.select(key, "_slice").distinct().join(unique, key)
    return dealt.join(copies, [key, "_slice"], how).drop("_slice")


def components(edges: DataFrame, *, split_hubs: bool = False) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b); component is the
    smallest node that can be reached.

    In each step a node takes the smallest label among its neighbours and then its label's own
    label, so chains shorten about by half a step. Labels are combined before each shuffle; a
    node with very many edges is a partial sum and not a group. Each step's labels are a stored
    table, so plans stay short.

    With ``split_hubs`` neither the edges of one node nor the nodes of one label come together
    in one task of a join; it costs moving each edge's and each node's ids once more a step, unless
    the graph is one slice in all.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.first("a"), F.min("b")).alias("label")
    )
    labels = stored(labels, "labels")
    edge_slices, node_slices = (t.count() // SLICE if split_hubs else 1 for t in (both, labels))
    while True:
        near = (
            join_dealt(both, "b", "a", labels.withColumnRenamed("node", "b"), edge_slices)
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        taken = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("mid")
        )
        if node_slices > 1:
            taken = stored(taken, "labels-taken")
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = join_dealt(taken, "mid", "node", jump, node_slices, "left").select(
            "node", F.least("mid", F.coalesce("far", "mid")).alias("label"),
            (F.least("mid", F.coalesce("far", "mid")) < F.col("old")).alias("changed"),
        )
        step = stored(step, "labels")
        labels = step.select("node", "label")
        if step.filter("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")
