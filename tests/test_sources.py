"""Reading, writing and the shared folder."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from caudal.plans import kpis
from caudal.schemas import BANK_TABLES, PRIMARY_KEYS, schema
from caudal.session import scratch_path
from caudal.sources import sinks
from caudal.sources.sample_bank import PROJECTIONS, sample_bank
from caudal.sources.tables import (
    Tables, extract, key_slices, month_slices, read_exchange_rates, table_or_empty,
)
from tests.conftest import SAMPLE, plan_of, rows_of


def test_declared_schemas():
    assert len(BANK_TABLES) == 15
    for name in BANK_TABLES:
        assert PRIMARY_KEYS[name] in schema(name).fieldNames()


def test_sample_columns_have_the_declared_types(spark):
    t = sample_bank(spark, SAMPLE)
    for name in (*BANK_TABLES, "tipo_cambio"):
        declared = {f.name: f.dataType for f in schema(name).fields}
        for field in t[name].schema.fields:
            assert field.dataType == declared[field.name], (name, field)
    assert set(PROJECTIONS) == {*BANK_TABLES, "transacciones_con_hora"}


def test_sample_keys_are_unique(spark):
    t = sample_bank(spark, SAMPLE)
    for name in ("clientes", "cuentas", "transacciones", "prestamos", "tipo_cambio"):
        key = PRIMARY_KEYS[name]
        assert t[name].count() == t[name].select(key).distinct().count()


def test_csv_extract_reads_back(spark, tmp_path):
    t = sample_bank(spark, SAMPLE)
    extract(t, str(tmp_path), fmt="csv", names=("transacciones", "open_data"))
    extract(t, str(tmp_path), fmt="csv", names=("transacciones",))  # replaces
    again = Tables.from_csv(spark, str(tmp_path))
    # The CSV holds the columns in the order they were written.
    read = spark.read.schema(t.transacciones.schema).option("header", True).csv(
        str(tmp_path / "transacciones"))
    assert read.exceptAll(t.transacciones).count() == 0 and read.count() == t.transacciones.count()
    assert again.transacciones.columns == schema("transacciones").fieldNames()
    assert rows_of(kpis.kpi_transacciones_por_canal(again)) == rows_of(kpis.kpi_transacciones_por_canal(t))


def test_exchange_rate_csv(spark, tmp_path):
    path = tmp_path / "rates.csv"
    path.write_text("Fecha,Dato\n31/12/2023,16.8935\n01/02/2024,N/E\nmal,17.0000\n")
    assert rows_of(read_exchange_rates(spark, str(path))) == [
        {"fecha": dt.date(2023, 12, 31), "rate": D("16.8935")},
        {"fecha": dt.date(2024, 2, 1), "rate": None},
        {"fecha": None, "rate": D("17.0000")},
    ]


def test_missing_table_is_empty(spark):
    empty = table_or_empty(spark, "no_such_table", "a string, b bigint")
    assert empty.columns == ["a", "b"] and empty.count() == 0
    spark.range(3).createOrReplaceTempView("there_is_one")
    assert table_or_empty(spark, "there_is_one", "id bigint").count() == 3


def test_replace_load_into_the_catalog(spark):
    for n in (5, 3):
        sinks.replace_catalog_tables({"prueba": spark.range(n)})
    assert spark.table("etl_prueba").count() == 3


def test_transactions_by_month(spark, tmp_path):
    t = sample_bank(spark, SAMPLE)
    path = str(tmp_path / "tx")
    sinks.write_transactions_by_month(t.transacciones, path)
    some = sinks.read_transactions_by_month(spark, path, desde="1996-02-10", hasta="1996-04-01")
    expected = t.transacciones.filter(F.col("fecha").between("1996-02-10", "1996-04-01"))
    assert some.exceptAll(expected.select(some.columns)).count() == 0
    assert some.count() == expected.count() > 0
    assert "PartitionFilters: [isnotnull(anio_mes" in plan_of(some)
    assert sinks.read_transactions_by_month(spark, path).count() == t.transacciones.count()


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(shared) and first != second


def test_month_slices_cover_every_row_once(spark):
    slices = month_slices("fecha", "1996-11", "1997-02")
    assert len(slices) == 7
    tx = sample_bank(spark, SAMPLE).cuentas.select(F.col("fecha_apertura").alias("fecha"))
    hits = sum((F.coalesce(F.expr(s), F.lit(False)).cast("int") for s in slices), F.lit(0))
    assert [r.n for r in tx.select(hits.alias("n")).distinct().collect()] == [1]


def test_etl_command(spark, tmp_path, capsys):
    from caudal.__main__ import main

    t = sample_bank(spark, SAMPLE, timed=True)
    extract(t, str(tmp_path / "bank"), names=("transacciones", "clientes", "datos_personales", "cuentas"))
    rates = tmp_path / "rates.csv"
    rates.write_text("Fecha,Dato\n01/01/2024,17.0000\n")
    main(["etl", "--tables", str(tmp_path / "bank"), "--rates", str(rates), "--mart", str(tmp_path / "mart")])
    assert "total_transacciones" in capsys.readouterr().out
    assert len(list((tmp_path / "mart").glob("load-*/etl_alertas_fraude"))) == 1


def test_key_slices_cover_every_row_once(spark):
    """Applied to a frame in the database's place."""
    rows = [(i * i, f"O'Neil {i:04d}", dt.date(2020, 1, 1) + dt.timedelta(days=i), dt.datetime(2020, 1, 1, 0, 0, i % 60, i)) for i in range(500)]
    rows += [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "n long, name string, d date, at timestamp_ntz")
    new = spark.createDataFrame([(-5, "A", dt.date(1990, 1, 1), dt.datetime(1990, 1, 1)), (10**9, "z", dt.date(2090, 1, 1), dt.datetime(2090, 1, 1))], df.schema)
    counts = lambda frame, slices: list(frame.agg(*[F.count(F.when(F.expr(x), 1)) for x in slices]).first())
    for column in df.columns:
        slices = key_slices(df, column, 8)
        assert len(slices) == 9
        sizes = counts(df, slices)
        assert sum(sizes) == 503 and sizes[-1] == 3 and max(sizes[:-1]) < 120
        assert [i for i, n in enumerate(counts(new, slices)) if n] == [0, 7]
    assert key_slices(df.limit(0), "n", 8) == ["n IS NOT NULL", "n IS NULL"]
    one = spark.createDataFrame([(7,)] * 50, "n long")
    assert sum(counts(one, key_slices(one, "n", 4))) == 50
