"""Replace-load sinks and the views the serving queries read."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caudal.functions.dates import as_date, month_label, whole_days
from caudal.schemas import schema

MONTH = "anio_mes"
MART_PREFIX = "etl_"
VIEW_PREFIX = "dwh_"


def new_load(folder: str) -> str:
    """A folder for one load, whose name sorts behind those of earlier loads."""
    at = dt.datetime.now(dt.UTC).strftime("%Y%m%dT%H%M%S%f")
    return os.path.join(folder, f"load-{at}-{uuid.uuid4().hex[:8]}")


def replace_tables(
    frames: Mapping[str, DataFrame], folder: str, *, fmt: str = "parquet"
) -> dict[str, str]:
    """Writes each frame to ``<folder>/etl_<name>``; running it again replaces the data."""
    paths = {}
    for name, frame in frames.items():
        path = os.path.join(folder, MART_PREFIX + name)
        writer = frame.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(path)
        paths[name] = path
    return paths


def replace_catalog_tables(frames: Mapping[str, DataFrame], database: str | None = None) -> None:
    """As :func:`replace_tables`, into catalog tables ``[database.]etl_<name>``."""
    for name, frame in frames.items():
        table = f"{database}.{MART_PREFIX}{name}" if database else MART_PREFIX + name
        frame.write.mode("overwrite").saveAsTable(table)


def replace_jdbc(
    frames: Mapping[str, DataFrame], url: str, properties: Mapping[str, str]
) -> None:
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite").format("jdbc").option("url", url)
        for key, value in properties.items():
            writer = writer.option(key, value)
        writer.option("dbtable", MART_PREFIX + name).save()


def publish_views(spark: SparkSession, paths: Mapping[str, str], schemas: Mapping[str, str]) -> None:
    """Session views ``dwh_<name>`` over the written tables."""
    for name, path in paths.items():
        spark.read.schema(schemas[name]).parquet(path).createOrReplaceTempView(VIEW_PREFIX + name)


def write_transactions_by_month(transacciones: DataFrame, path: str) -> None:
    """Transactions laid out in one folder per month.

    The rebalance hint makes evenly sized files: AQE splits a month that holds much of the
    data over many tasks and packs small ones together, so no month is one task's work and
    no task scatters files over all months.
    """
    (
        transacciones.withColumn(MONTH, month_label(F.col("fecha")))
        .hint("rebalance", F.col(MONTH))
        .write.mode("overwrite")
        .partitionBy(MONTH)
        .parquet(path)
    )


def read_transactions_by_month(
    spark: SparkSession,
    path: str,
    *,
    desde: str | dt.date | None = None,
    hasta: str | dt.date | None = None,
) -> DataFrame:
    """The transactions of [desde, hasta]; folders of other months are not read."""
    laid_out = T.StructType([*schema("transacciones").fields, T.StructField(MONTH, T.StringType())])
    tx = spark.read.schema(laid_out).parquet(path)
    if desde is not None:
        tx = tx.filter(F.col(MONTH) >= as_date(desde).strftime("%Y-%m"))
    if hasta is not None:
        tx = tx.filter(F.col(MONTH) <= as_date(hasta).strftime("%Y-%m"))
    return tx.filter(whole_days(F.col("fecha"), desde, hasta)).drop(MONTH)
