"""Where the banking tables come from: Parquet, CSV, JDBC or frames at hand."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from caudal.schemas import BANK_TABLES, schema


class Tables:
    """Banking tables by name, each opened at most once: ``t.clientes``, ``t["clientes"]``."""

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open = open_table
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._open(name)
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def replacing(self, **frames: DataFrame) -> Tables:
        """The same tables with some taken from elsewhere."""
        return Tables(lambda name: frames[name] if name in frames else self[name])

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(frames.__getitem__)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Tables:
        """``<folder>/<table>`` directories (or ``.parquet`` files), declared schemas."""
        return cls(
            lambda name: spark.read.schema(schema(name)).parquet(os.path.join(folder, name))
        )

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str) -> Tables:
        """CSV extracts with a header row, one folder or file per table."""
        return cls(
            lambda name: spark.read.schema(schema(name))
            .option("header", True)
            .csv(os.path.join(folder, name))
        )

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: Mapping[str, str],
        slices: Mapping[str, list[str]] | None = None,
    ) -> Tables:
        """Database tables; ``slices`` gives the predicates that split each large one."""
        slices = slices or {}
        return cls(lambda name: read_jdbc(spark, url, name, properties, slices.get(name)))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    slices: list[str] | None = None,
) -> DataFrame:
    """A database table, read as one task per predicate of ``slices``.

    Without slices one task reads the whole table, which only suits small ones.
    """
    if slices:
        return spark.read.jdbc(url, table, predicates=slices, properties=dict(properties))
    return spark.read.jdbc(url, table, properties=dict(properties))


def month_slices(column: str, first: str, last: str) -> list[str]:
    """Predicates that split a table by month of ``column`` (``YYYY-MM`` bounds, inclusive).

    Together they cover every row once: what is before, after or NULL has slices too.
    """
    def number(month: str) -> int:
        year, of_year = month.split("-")
        return int(year) * 12 + int(of_year) - 1

    def day(n: int) -> str:
        return f"DATE '{n // 12:04d}-{n % 12 + 1:02d}-01'"

    start, stop = number(first), number(last) + 1
    inside = [f"{column} >= {day(n)} AND {column} < {day(n + 1)}" for n in range(start, stop)]
    return [f"{column} < {day(start)}", *inside, f"{column} >= {day(stop)}", f"{column} IS NULL"]


def _literal(value: object) -> str:
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def key_slices(keys: DataFrame, column: str, n: int) -> list[str]:
    """Predicates that split a table into about ``n`` parts of equal size by quantiles of a key.

    ``keys`` holds the column, from an earlier extract or a narrow read. Spark's range partitioning
    finds the borders, so no key is counted on the driver; ``n`` of them come back. Together the
    predicates cover every row once, NULL included, also rows whose key is new since: the first
    and the last slice are open. A key that holds more than its share of rows is one slice. Text
    keys must sort bytewise in the database, as they do in Spark.
    """
    ranges = keys.select(column).dropna().repartitionByRange(n, column)
    found = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min(column).alias("low"))
    borders = [_literal(row["low"]) for row in found.orderBy("low").collect()][1:]
    if not borders:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inside = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(borders, borders[1:], strict=False)]
    return [f"{column} < {borders[0]}", *inside, f"{column} >= {borders[-1]}", f"{column} IS NULL"]


def read_exchange_rates(
    spark: SparkSession,
    path: str,
    *,
    columns: tuple[str, str] = ("fecha", "rate"),
    date_format: str = "dd/MM/yyyy",
) -> DataFrame:
    """Daily exchange-rate CSV: dates as ``dd/mm/yyyy``, two columns of any name.

    Rows whose date or rate cannot be read come back as NULL there.
    """
    raw = spark.read.schema("dia string, valor string").option("header", True).csv(path)
    day, value = columns
    return raw.select(
        F.try_to_timestamp("dia", F.lit(date_format)).cast("date").alias(day),
        F.expr("try_cast(valor AS decimal(10,4))").alias(value),
    )


def table_or_empty(spark: SparkSession, name: str, ddl: str) -> DataFrame:
    """The table or view ``name``, or no rows of the given shape where it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], ddl)


def extract(tables: Tables, folder: str, *, fmt: str = "parquet", names=BANK_TABLES) -> None:
    """Writes every bank table under ``folder``, replacing what an earlier run left."""
    for name in names:
        writer = tables[name].write.mode("overwrite")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(os.path.join(folder, name))
