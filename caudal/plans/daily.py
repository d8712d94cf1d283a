"""Transactions added up per day, channel and category, kept from one run to the next.

Figures by month, quarter, year, channel or category are sums of these rows, of which a day has
a few dozen, however many transactions it has. Plans take them as ``diario`` in place of a scan.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caudal.functions.numbers import count_true
from caudal.sources.mart import commit_load, loads
from caudal.sources.sinks import new_load

TABLE = "volumen_diario"
_DDL = "dia date, canal string, categoria string, n long, fraudes long, monto decimal(22,2), ultima timestamp_ntz"
# The start of a refresh that replaces all earlier ones.
_ALL = dt.date(1, 1, 1)


def daily_volume(tx: DataFrame) -> DataFrame:
    """dia, canal, categoria, n, fraudes, monto, ultima; combined map-side, sums are exact."""
    return tx.groupBy(F.to_date("fecha").alias("dia"), "canal", "categoria").agg(
        F.count("*").alias("n"), count_true(F.col("es_fraude_potencial")).alias("fraudes"),
        F.sum("monto").alias("monto"), F.max("fecha").alias("ultima"),
    )


def refresh_daily(
    spark: SparkSession, tx: DataFrame, folder: str, *, desde: dt.date | None = None, full: bool = False
) -> None:
    """Adds up what is new: the days from ``desde`` on, by default from the last day stored.

    That day is added up again, as it may have been cut short; ``desde`` reaches back further
    for rows that came late, and ``full`` starts over. The day's bound reaches the scan. Rows
    without a time are added up every time. A refresh is committed by its entry in the folder's
    manifest: one that was cut off changes nothing, and a repeated one gives the same rows.
    """
    if full:
        desde = None
    elif desde is None:
        desde = stored_daily(spark, folder).agg(F.max("dia")).first()[0]
    new = tx if desde is None else tx.filter((F.col("fecha") >= F.lit(desde)) | F.col("fecha").isNull())
    load = new_load(folder)
    path = os.path.join(folder, TABLE, f"carga={os.path.basename(load)}")
    daily_volume(new).write.parquet(path)
    commit_load(spark, folder, load, {TABLE: path}, source=(desde or _ALL).isoformat())


def stored_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all committed refreshes, each day from the newest that covers it.

    A refresh counts for the days before the start of all later ones; the newest counts for all
    its days and for rows without a time. The plan does not grow with the number of refreshes:
    they are one table, joined with a row for each.
    """
    entries = loads(spark, folder).filter(F.col("tabla") == TABLE)
    if entries.isEmpty():
        return spark.createDataFrame([], _DDL)
    # One row per refresh.
    until = F.expr(
        "min(to_date(origen)) OVER (ORDER BY carga ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    )
    valid = entries.select("carga", until.alias("hasta"))
    rows = (
        spark.read.schema(f"{_DDL}, carga string").option("basePath", os.path.join(folder, TABLE))
        .parquet(os.path.join(folder, TABLE))
    )
    current = rows.join(valid, "carga").filter(F.col("hasta").isNull() | (F.col("dia") < F.col("hasta")))
    return current.drop("carga", "hasta")


def rest_of_day(tx: DataFrame, cut: DataFrame) -> DataFrame:
    """The transactions from an instant to the end of its day; ``cut`` is one row with ``corte``.

    Both bounds reach the scan.
    """
    start = cut.select("corte").scalar()
    next_day = cut.select(F.date_add(F.to_date("corte"), 1).cast("timestamp_ntz")).scalar()
    return tx.filter((F.col("fecha") >= start) & (F.col("fecha") < next_day))


def is_later_day(cut: DataFrame) -> Column:
    """Whether ``dia`` lies behind the day of the instant: rows that count as a whole."""
    return F.col("dia") > cut.select(F.to_date("corte")).scalar()


def volume_since(tx: DataFrame, diario: DataFrame, cut: DataFrame) -> DataFrame:
    """The daily rows of all transactions from an instant on: whole days from ``diario``, and what
    remains of the instant's own day from the transactions."""
    return diario.filter(is_later_day(cut)).unionByName(daily_volume(rest_of_day(tx, cut)))
