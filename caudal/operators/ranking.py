"""Top-k, pages and latest-N-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caudal.functions.numbers import as_count
from caudal.operators.spread import plain_side


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Ordered first ``k`` rows; planned as a per-partition top-k and a merge."""
    return df.orderBy(*order).limit(k)


def page_of(df: DataFrame, page: int, limit: int, *order: Column | str) -> DataFrame:
    """Page ``page`` (1-based) of an ordering that must end in a unique key.

    The cost grows with ``page * limit``; use :func:`page_after` to walk deep.
    """
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_after(df: DataFrame, limit: int, beyond: Column, *order: Column | str) -> DataFrame:
    """The next ``limit`` rows beyond a known key; every page costs the same."""
    return df.filter(beyond).orderBy(*order).limit(limit)


def page_info(df: DataFrame, page: int, limit: int) -> DataFrame:
    """One row: total, page, limit, totalPages."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        as_count(F.ceil(F.col("total") / F.lit(limit))).alias("totalPages"),
    )


def latest_per_key(df: DataFrame, key: str, n: int, at: str, *order: Column) -> DataFrame:
    """Latest ``n`` rows of each key by ``at``, ties by ``order``, which must end in a unique column.

    Rows are counted per key and day first, combined map-side and over two columns only. From
    the latest day backwards, the day that completes ``n`` rows is the earliest that matters: the
    rows of older days meet no sort and no shuffle of whole rows. Of the others each task keeps
    ``n`` per key before they are dealt by key, so a key that holds much of the table does not
    come together in one task. Rows without a time count as the oldest.
    """
    day = F.to_date(at)
    counts = df.groupBy(F.col(key).alias("_key"), day.alias("_day")).agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("_key").orderBy(F.desc_nulls_last("_day"))
    newer = newer.rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    # No day: rows without a time are needed, too.
    cut = reached.filter(F.col("_newer") < n).groupBy("_key").agg(
        F.min("_day").alias("_from"), F.max(F.col("_day").isNull()).alias("_all")
    )
    recent = df.join(
        plain_side(cut), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_all") | (day >= F.col("_from"))),
        "left_semi",
    )
    spec = Window.partitionBy(key).orderBy(F.desc_nulls_last(at), *order)
    return recent.withColumn("_rn", F.row_number().over(spec)).filter(F.col("_rn") <= n).drop("_rn")
