"""Layouts for lookups: tables clustered by a key, and lists numbered for pages.

Both deal the rows over ranges of their order and sort each range. An order that ends in a
unique column lets Spark cut a key with very many rows into several ranges.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caudal.functions.numbers import as_count
from caudal.schemas import BANK_TABLES, PRIMARY_KEYS
from caudal.sources.mart import commit_load, current_load
from caudal.sources.sinks import new_load
from caudal.sources.tables import Tables

ROWS_PER_PART = 1_000_000
# Small row groups, as a lookup reads whole ones; distinct values a Bloom filter is made for.
ROW_GROUP_BYTES = 16 << 20
BLOOM_VALUES = 200_000
CLIENT = "id_cliente"
# What comes behind the client in a clustered table; the table's own key ends the order.
_THEN = {
    "transacciones": ("fecha",), "cuentas": ("fecha_apertura",), "prestamos": ("fecha_otorgamiento",),
    "pagos": ("fecha_pago",), "cobros": ("fecha_cobro",), "metas_ahorro": ("fecha_objetivo",),
}
# Where a numbered row lies: its part, and its place in the part from 0.
PART, PLACE = "_parte", "_lugar"


def _ranges(df: DataFrame, rows: int, rows_per_part: int, order: Iterable[Column | str]) -> DataFrame:
    parts = max(1, -(-rows // rows_per_part))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


# ── clustered tables ────────────────────────────────────────────────────────────────────

def write_clustered(
    df: DataFrame, path: str, *order: Column | str, blooms: Iterable[str] = (),
    rows_per_part: int = ROWS_PER_PART, row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Rows in the given order over files and row groups.

    The smallest and largest value that Parquet keeps of each row group then lead a filter on
    the first column to the few that can hold it. Columns of ``blooms``, which the order
    scatters, get Bloom filters, which lead a filter on one of their values to about one.
    """
    writer = _ranges(df, df.count(), rows_per_part, order).write.mode("overwrite")
    writer = writer.option("parquet.block.size", row_group_bytes)
    for column in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", BLOOM_VALUES)
    writer.parquet(path)


def lay_out_by_client(
    tables: Tables, folder: str, *, names: Iterable[str] = BANK_TABLES, **sizes: int
) -> None:
    """Writes bank tables clustered by client, each with a Bloom filter on its own key.

    ``Tables.from_parquet(spark, folder)`` reads them, and every plan runs on them as it is:
    the lookups' filters on ids reach the scan, which reads a few row groups.
    """
    for name in names:
        key = PRIMARY_KEYS[name]
        columns = set(tables[name].columns)
        order = [c for c in (CLIENT, *_THEN.get(name, ()), key) if c in columns]
        blooms = [] if key == CLIENT else [key]
        write_clustered(
            tables[name], os.path.join(folder, name), *dict.fromkeys(order), blooms=blooms, **sizes
        )


# ── numbered lists ──────────────────────────────────────────────────────────────────────

def write_pages(
    df: DataFrame, folder: str, *order: Column | str, rows_per_part: int = ROWS_PER_PART
) -> None:
    """Stores a list in its order, which must end in a unique column, so that any page is a read.

    Each row carries its part and its place in it. How many rows come before each part is a
    second, small table: one row per part, added up in one pass. Both are a committed load:
    readers see the list of the last complete run.
    """
    spark = df.sparkSession
    n = df.count()
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
    placed = (
        _ranges(df, n, rows_per_part, order).withColumn("_at", at)
        .withColumn(PART, F.shiftright("_at", 33).cast("int"))
        .withColumn(PLACE, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")
        .sortWithinPartitions(PART, PLACE)
    )
    load = new_load(folder)
    paths = {name: os.path.join(load, name) for name in ("filas", "rangos")}
    placed.write.partitionBy(PART).parquet(paths["filas"])
    # An empty list has no folder that could be read back.
    if n == 0:
        spark.createDataFrame([], "parte int, n long, desde long").write.parquet(paths["rangos"])
    else:
        counts = spark.read.parquet(paths["filas"]).groupBy(F.col(PART).alias("parte")).agg(F.count("*").alias("n"))
        before = F.expr("sum(n) OVER (ORDER BY parte ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n")
        counts.withColumn("desde", before).coalesce(1).write.parquet(paths["rangos"])
    commit_load(spark, folder, load, paths, source=df.schema.json())


def stored_page(spark: SparkSession, folder: str, page: int, limit: int) -> DataFrame:
    """Page ``page`` (1-based) of a stored list, in its order.

    Reads the page's rows from the one or few parts that hold them, whatever the page's number:
    parts are folders, and places inside a part are sorted bounds that reach the scan.
    """
    rows, ranges = _opened(spark, folder)
    first, last = (page - 1) * limit, page * limit
    # No more parts than the page has rows.
    found = ranges.filter((F.col("desde") < last) & (F.col("desde") + F.col("n") > first)).collect()
    inside = [
        (F.col(PART) == r["parte"]) & (F.col(PLACE) >= max(0, first - r["desde"]))
        & (F.col(PLACE) < min(r["n"], last - r["desde"]))
        for r in found
    ]
    if not inside:
        return rows.drop(PART, PLACE).limit(0)
    chosen = rows.filter(F.col(PART).isin([r["parte"] for r in found])).filter(reduce(Column.__or__, inside))
    return chosen.orderBy(PART, PLACE).drop(PART, PLACE)


def stored_page_info(spark: SparkSession, folder: str, page: int, limit: int) -> DataFrame:
    """One row: total, page, limit, totalPages; the list itself is not read."""
    _, ranges = _opened(spark, folder)
    total = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return total.select(
        "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"),
        as_count(F.ceil(F.col("total") / F.lit(limit))).alias("totalPages"),
    )


def _opened(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found = current_load(spark, folder)
    if found is None:
        raise ValueError(f"no list stored in {folder}")
    kept = T.StructType.fromJson(json.loads(found.source))
    placed = T.StructType([*kept.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.IntegerType())])
    ranges = spark.read.schema("parte int, n long, desde long").parquet(found.paths["rangos"])
    return spark.read.schema(placed).parquet(found.paths["filas"]), ranges
