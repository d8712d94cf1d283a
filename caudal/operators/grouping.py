"""Grouped counts, shares of a total, and one-row summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caudal.functions.numbers import pct_of_counts


def count_by(df: DataFrame, key: Column | str, name: str, total: str = "total") -> DataFrame:
    """Non-null groups and their row counts."""
    key = F.col(key) if isinstance(key, str) else key
    return (
        df.select(key.alias(name))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count("*").alias(total))
    )


def with_share(
    grouped: DataFrame, total: str = "total", share: str = "porcentaje", digits: int = 2
) -> DataFrame:
    """Adds each group's share of all counted rows, in percent.

    Meant for enumerations such as statuses and channels. The total is a window over the
    grouped rows: what meets in one task is one row per distinct value, never the table's
    rows, and whatever produced the groups runs once.
    """
    grand_total = F.sum(total).over(Window.partitionBy())
    return grouped.withColumn(share, pct_of_counts(F.col(total), grand_total, digits))


def share_by(df: DataFrame, key: str, name: str) -> DataFrame:
    shared = with_share(count_by(df, key, name))
    return shared.orderBy(F.desc("total"), name)


def one_row(*summaries: DataFrame) -> DataFrame:
    """Puts one-row summaries of different tables side by side.

    A union of as many rows as there are summaries, folded by ``max``; the tables'
    aggregations run as independent stages of one job and nothing is cross joined.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def unpivot_row(row: DataFrame, entries: list[dict[str, Column]]) -> DataFrame:
    """Turns the columns of a one-row frame into rows; ``entries`` describe one row each."""
    structs = [F.struct(*[c.alias(n) for n, c in entry.items()]) for entry in entries]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
