"""Clustered tables and stored lists: what they give, and how little a lookup reads."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caudal.plans import lookups
from caudal.session import settings
from caudal.sources import layouts
from caudal.sources.mart import loads
from caudal.sources.sample_bank import sample_bank
from caudal.sources.tables import Tables
from tests.conftest import SAMPLE, rows_of


def rows_scanned(df) -> int:
    """Collects and says how many rows the scans gave: those of the row groups that were read."""
    # Without AQE the executed plan's leaves are the scans themselves.
    with settings(df.sparkSession, spark__sql__adaptive__enabled="false"):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("por-cliente"))
    t = sample_bank(spark, SAMPLE)
    layouts.lay_out_by_client(
        t, folder, names=("transacciones", "clientes", "cuentas"), rows_per_part=1000, row_group_bytes=4096
    )
    return t, Tables.from_parquet(spark, folder), folder


def test_one_client_reads_few_row_groups(spark, laid_out):
    t, by_client, _ = laid_out
    total = t.transacciones.count()
    one = by_client.transacciones.filter(F.col("id_cliente") == "C7")
    assert 0 < rows_scanned(one) < total / 5
    # A key that the order scatters is found by its Bloom filters.
    some_id = t.transacciones.agg(F.max("id_transaccion")).first()[0]
    other = by_client.transacciones.filter(F.col("id_transaccion") == some_id)
    assert other.count() == 1
    assert rows_scanned(other) < total / 5


def test_lookups_over_clustered_tables(spark, laid_out):
    t, by_client, _ = laid_out
    ids = [r[0] for r in t.transacciones.select("id_cliente").distinct().orderBy("id_cliente").limit(2).collect()]
    for plan in (lookups.cliente_transacciones, lookups.cliente_cuentas):
        for wanted in (ids[0], [*ids, "nadie"]):
            expected = plan(t, wanted)
            assert rows_of(plan(by_client, wanted).select(expected.columns)) == rows_of(expected)
        assert rows_of(plan(by_client, ids))
    everything = by_client.transacciones
    assert everything.exceptAll(t.transacciones).isEmpty() and t.transacciones.exceptAll(everything).isEmpty()


def test_a_client_with_a_third_of_the_rows_is_several_files(spark, frame, tmp_path):
    rows = [
        {"id_transaccion": f"t{i:05}", "id_cliente": "hot" if i % 3 == 0 else f"c{i}", "fecha": dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)}
        for i in range(3000)
    ]
    t = Tables.from_frames({"transacciones": frame("transacciones", rows)})
    layouts.lay_out_by_client(t, str(tmp_path), names=["transacciones"], rows_per_part=200)
    back = Tables.from_parquet(spark, str(tmp_path)).transacciones
    of_hot = back.filter("id_cliente = 'hot'").select(F.input_file_name().alias("f")).distinct().count()
    assert of_hot >= 4 and back.count() == 3000


# ── stored lists ────────────────────────────────────────────────────────────────────────

def some_transactions(n):
    """Ties in time, and rows without one."""
    return [
        {"id_transaccion": f"t{i * 7919 % n:05}", "id_cliente": f"c{i % 11}", "monto": Decimal(i),
         "fecha": None if i % 50 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 4)}
        for i in range(n)
    ]


def test_stored_pages_equal_computed_ones(spark, bank, tmp_path):
    t = bank(transacciones=some_transactions(997), clientes=[{"id_cliente": f"c{i}", "nombre": "N"} for i in range(10)])
    folder = str(tmp_path / "lista")
    lookups.store_transacciones(t, folder, rows_per_part=100)
    for page, limit in ((1, 50), (2, 50), (3, 130), (20, 50), (21, 50), (1, 2000), (997, 1)):
        expected = lookups.transacciones_list(t, page=page, limit=limit)
        assert rows_of(lookups.transacciones_stored_page(spark, t, folder, page=page, limit=limit)) == rows_of(expected)
    facts = layouts.stored_page_info(spark, folder, 3, 50)
    assert rows_of(facts) == rows_of(lookups.transacciones_list_info(t, page=3, limit=50))


def test_a_deep_page_reads_as_little_as_the_first(spark, bank, tmp_path):
    t = bank(transacciones=some_transactions(6000))
    folder = str(tmp_path / "lista")
    lookups.store_transacciones(t, folder, rows_per_part=500)
    scanned = [rows_scanned(layouts.stored_page(spark, folder, page, 20)) for page in (1, 150, 290)]
    assert max(scanned) <= 2 * 700, scanned


def test_stored_clients(spark, tmp_path):
    t = sample_bank(spark, SAMPLE)
    folder = str(tmp_path / "clientes")
    lookups.store_clientes(t, folder, rows_per_part=40, segmento="BUILDING")
    for page in (1, 3):
        expected = lookups.clientes_list(t, page=page, limit=7, segmento="BUILDING")
        assert rows_of(lookups.clientes_stored_page(spark, t, folder, page=page, limit=7)) == rows_of(expected)


def test_an_empty_list_and_a_run_that_was_cut_off(spark, bank, tmp_path, monkeypatch):
    folder = str(tmp_path / "lista")
    with pytest.raises(ValueError):
        layouts.stored_page(spark, folder, 1, 10)
    lookups.store_transacciones(bank(), folder)
    assert rows_of(layouts.stored_page(spark, folder, 1, 10)) == []
    assert rows_of(layouts.stored_page_info(spark, folder, 1, 10)) == [{"total": 0, "page": 1, "limit": 10, "totalPages": 0}]
    t = bank(transacciones=some_transactions(30))
    with monkeypatch.context() as m:
        m.setattr(layouts, "commit_load", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            lookups.store_transacciones(t, folder)
    assert rows_of(layouts.stored_page(spark, folder, 1, 10)) == []
    lookups.store_transacciones(t, folder)
    assert len(rows_of(layouts.stored_page(spark, folder, 3, 10))) == 10
    assert loads(spark, folder).select("carga").distinct().count() == 2
    assert len(os.listdir(folder)) >= 4
