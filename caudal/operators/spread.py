"""Joins whose hot keys Spark can split at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plain_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose other side may have keys with very many rows.

    AQE splits a hot key of one side when the other side is a plain shuffle, and not while an
    aggregation or a join that used the same key stands between. For a side that comes from
    one, this puts a shuffle of its own behind it. It costs moving ``df`` once more, which has
    one row per key.
    """
    return df.hint("rebalance")
