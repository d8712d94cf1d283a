"""Committed loads of a mart folder.

A load writes its tables to a folder of its own and becomes visible by one file, written last: its
entry in the manifest. Any session that can read the folder finds the current load there, without
views and without loading again; a load that was cut off before its entry does not exist.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from caudal.schemas import MART_DDL
from caudal.sources.sinks import publish_views
from caudal.sources.tables import Tables

MANIFEST = "manifiesto"
_ENTRY = "carga string, tabla string, ruta string, tablas int, origen string, terminada timestamp"


@dataclass(frozen=True)
class Load:
    """A load that was committed: its folder's name, what it was made from, and its tables' paths."""

    name: str
    source: str
    paths: dict[str, str]


def commit_load(
    spark: SparkSession, folder: str, load: str, paths: Mapping[str, str], *, source: str = ""
) -> None:
    """Makes the load in the subfolder ``load`` the current one.

    All its rows are one file, so readers see all of them or none. Paths are kept relative to the
    folder, which may be copied or mounted elsewhere.
    """
    base = folder.rstrip("/") + "/"
    name = os.path.basename(load.rstrip("/"))
    rows = [(name, table, path.removeprefix(base), len(paths), source) for table, path in paths.items()]
    entry = spark.createDataFrame(rows, _ENTRY.rpartition(",")[0]).withColumn("terminada", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(os.path.join(folder, MANIFEST))


def loads(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest: a row per committed load and table; none before the first load."""
    try:
        return spark.read.schema(_ENTRY).parquet(os.path.join(folder, MANIFEST))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def current_load(spark: SparkSession, folder: str, *, load: str | None = None) -> Load | None:
    """The newest committed load, or the one named ``load``; None where there is none.

    Loads are named by the time they began. What reaches the driver is one load's few paths.
    """
    entries = loads(spark, folder)
    if load is not None:
        entries = entries.filter(F.col("carga") == load)
    found = (
        entries.groupBy("carga")
        .agg(
            F.max("origen").alias("origen"), F.max("tablas").alias("tablas"),
            F.map_from_entries(F.collect_set(F.struct("tabla", "ruta"))).alias("rutas"),
        )
        .filter(F.size("rutas") == F.col("tablas"))
        .orderBy(F.desc("carga")).limit(1).collect()
    )
    if not found:
        return None
    row = found[0]
    paths = {table: os.path.join(folder, path) for table, path in row["rutas"].items()}
    return Load(row["carga"], row["origen"], paths)


def open_mart(spark: SparkSession, folder: str, *, load: str | None = None) -> Tables:
    """The tables of the current load, or of a named one; those not loaded are empty."""
    found = current_load(spark, folder, load=load)
    paths = found.paths if found else {}

    def read(name: str) -> DataFrame:
        if name in paths:
            return spark.read.schema(MART_DDL[name]).parquet(paths[name])
        return spark.createDataFrame([], MART_DDL[name])

    return Tables(read)


def publish_current(spark: SparkSession, folder: str) -> Load | None:
    """Points the session's views ``dwh_<name>`` to the current load, for SQL over them."""
    found = current_load(spark, folder)
    if found:
        publish_views(spark, found.paths, MART_DDL)
    return found


def source_version(spark: SparkSession, folder: str) -> str:
    """What tells one state of a folder of Parquet files from another: their names, sizes and times.

    The files are listed, not read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(folder)
    )
    row = files.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bit_xor(F.xxhash64("path", "length", "modificationTime")), F.lit(0)).alias("marks"),
    ).first()
    return f"{row['n']}-{row['bytes']}-{row['marks'] & (2 ** 64 - 1):016x}"
