"""As-of lookup of a daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def daily_quotes(quotes: DataFrame, day: str, value: str) -> DataFrame:
    """One quote per day (the largest, if a day has several)."""
    return quotes.filter(F.col(value).isNotNull()).groupBy(day).agg(F.max(value).alias(value))


def carry_forward(quotes: DataFrame, day: str, value: str) -> DataFrame:
    """Every calendar day from the first quote to the last, with the latest quote so far.

    The window has no partition key on purpose: its input is one row per calendar day
    (about 365 a year), which no amount of transactions makes longer.
    """
    following = F.lead(day).over(Window.orderBy(day))
    spans = quotes.withColumn("_hasta", F.coalesce(F.date_sub(following, 1), F.col(day)))
    return spans.select(F.explode(F.sequence(F.col(day), F.col("_hasta"))).alias(day), value)


def join_as_of(df: DataFrame, on_date: Column, quotes: DataFrame, day: str, value: str) -> DataFrame:
    """Adds the quote in force on ``on_date``: the latest one not after it, NULL before the first.

    The filled calendar is broadcast: one row per day of the series, so its size is fixed
    by the calendar. Dates after the last quote take the last one.
    """
    unique = daily_quotes(quotes, day, value)
    filled = carry_forward(unique, day, value).select(
        F.col(day).alias("_dia"), F.col(value).alias("_valor")
    )
    last = unique.agg(F.max_by(F.struct(day, value), day).alias("u"))
    last_day, last_value = last.select(f"u.{day}").scalar(), last.select(f"u.{value}").scalar()
    return (
        df.withColumn("_dia", on_date)
        .join(F.broadcast(filled), "_dia", "left")
        .withColumn(
            value,
            F.coalesce(F.col("_valor"), F.when(F.col("_dia") > last_day, last_value)),
        )
        .drop("_dia", "_valor")
    )
