"""Counts over a trailing time range, exact under ties and heavy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caudal.functions.dates import seconds


def counts_per_instant(df: DataFrame, key: str, at: str) -> DataFrame:
    """Rows per key and timestamp: (key, at, n). Combined before the shuffle."""
    return df.groupBy(key, at).agg(F.count("*").alias("n"))


def slice_of(at: Column, within_seconds: int) -> Column:
    """The number of the slice of ``within_seconds`` that a timestamp lies in."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / (within_seconds * 1_000_000))


def busy_instants(
    instants: DataFrame, key: str, at: str, *, more_than: int, within_seconds: int
) -> DataFrame:
    """The (key, at) pairs whose trailing window ``(at - within, at]`` holds more than
    ``more_than`` rows; rows of the same instant are all inside the window.

    A sweep line keeps this linear, whatever the limit, and evenly spread:

    * the input has one row per key and instant, so ties never pile up;
    * each key's timeline is cut into slices as long as the window. An instant counts from its
      own time on, and until it expires one window later, which lies in the next slice: it is a
      plus in its own slice and a minus in the next one. A key with a third of all rows is then as
      many tasks as it has slices, and no window looks outside its slice;
    * at a slice's start all that will expire in it is inside, so the rows in a window are the sum
      of these and of all pluses and minuses up to its instant: one running sum over one sort.
    """
    span = seconds(within_seconds)
    own = slice_of(F.col(at), within_seconds)
    moves = instants.select(
        key, F.explode(F.array(
            F.struct(own.alias("tramo"), F.col(at).alias("en"), F.col("n").alias("mas"), F.lit(0).alias("menos")),
            F.struct((own + 1).alias("tramo"), (F.col(at) + span).alias("en"), F.lit(0).alias("mas"), F.col("n").alias("menos")),
        )).alias("m"),
    ).select(key, "m.*")
    part = Window.partitionBy(key, "tramo")
    # A range frame: what happens at the same instant, expiries included, counts at once.
    until_now = part.orderBy("en").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum("menos").over(part) + F.sum(F.col("mas") - F.col("menos")).over(until_now)
    return (
        moves.withColumn("dentro", inside)
        .filter((F.col("mas") > 0) & (F.col("dentro") > more_than))
        .select(key, F.col("en").alias(at))
    )
