"""Client and transaction lookups: filters, pages, missing parents."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caudal.operators.ranking import latest_per_key
from caudal.plans import lookups
from caudal.sources.sample_bank import sample_bank
from tests.conftest import SAMPLE, rows_of


@pytest.fixture
def small(bank):
    def client(i, name, surname):
        return {"id_cliente": i, "nombre": name, "apellido_paterno": surname}

    return bank(
        clientes=[
            client("C1", "Ana", "Ruiz"), client("C2", "Luis", "PÉREZ"),
            client("C3", "100%", "Ruiz"), client("C4", "Eva", "Soto"),
        ],
        open_data=[
            {"id_cliente": "C1", "segmento_cliente": "Oro", "nivel_riesgo": "Alto"},
            {"id_cliente": "C2", "segmento_cliente": "Oro", "nivel_riesgo": "Bajo"},
        ],
        datos_personales=[{"id_cliente": "C1", "email": "a@x.mx"}],
        cuentas=[
            {"num_cuenta": "A1", "id_cliente": "C1", "fecha_apertura": dt.date(2020, 1, 1)},
            {"num_cuenta": "A2", "id_cliente": "C1", "fecha_apertura": None},
            {"num_cuenta": "A3", "id_cliente": "C1", "fecha_apertura": dt.date(2022, 1, 1)},
            {"num_cuenta": "A9", "id_cliente": "C9", "fecha_apertura": dt.date(2022, 1, 1)},
        ],
        metas_ahorro=[
            {"id_meta": "M1", "id_cliente": "C1", "fecha_objetivo": None},
            {"id_meta": "M2", "id_cliente": "C1", "fecha_objetivo": dt.date(2025, 1, 1)},
        ],
        transacciones=[
            {"id_transaccion": "T1", "id_cliente": "C1", "fecha": dt.datetime(2024, 1, 1, 8), "es_fraude_potencial": True},
            {"id_transaccion": "T2", "id_cliente": "C1", "fecha": dt.datetime(2024, 1, 2, 8), "es_fraude_potencial": False},
            {"id_transaccion": "T3", "id_cliente": "C2", "fecha": dt.datetime(2024, 1, 2, 9), "es_fraude_potencial": None},
        ],
    )


def ids(df, column="id_cliente"):
    return [r[column] for r in rows_of(df)]


def test_filters(small):
    kept = lambda **f: sorted(ids(lookups.clientes_filtrados(small, **f)))
    assert kept() == ["C1", "C2", "C3", "C4"]
    assert kept(nombre="RUI") == ["C1", "C3"]
    assert kept(nombre="pér") == ["C2"]
    assert kept(nombre="%") == ["C3"]
    assert kept(segmento="Oro") == ["C1", "C2"]
    assert kept(segmento="Oro", riesgo="Bajo") == ["C2"]
    assert kept(riesgo="Medio") == []


def test_list_keeps_clients_without_satellites(small):
    page = rows_of(lookups.clientes_list(small, page=1, limit=3))
    assert [r["id_cliente"] for r in page] == ["C2", "C1", "C3"]
    assert page[1]["email"] == "a@x.mx" and page[2]["segmento_cliente"] is None
    (info,) = rows_of(lookups.clientes_list_info(small, page=1, limit=3))
    assert info == {"total": 4, "page": 1, "limit": 3, "totalPages": 2}


def test_next_page_by_key(small):
    after = lookups.clientes_list_after(small, apellido_paterno="Ruiz", id_cliente="C1", limit=2)
    assert ids(after) == ids(lookups.clientes_list(small, page=2, limit=2)) == ["C3", "C4"]


def test_profile(small, spark):
    (one,) = rows_of(lookups.cliente_perfil(small, "C1"))
    assert one["open_data"]["segmento_cliente"] == "Oro"
    assert one["datos_negocio"] is None
    assert rows_of(lookups.cliente_perfil(small, "nadie")) == []
    asked = spark.createDataFrame([("C2",), ("C2",), ("C9",)], "id_cliente string")
    assert ids(lookups.cliente_perfil(small, asked)) == ["C2"]


@pytest.mark.parametrize("how", ["one", "list", "frame", "all"])
def test_accounts_of_known_clients(small, spark, how):
    asked = {
        "one": "C1", "list": ["C1", "C9"], "all": None,
        "frame": spark.createDataFrame([("C1",), ("C9",)], "id_cliente string"),
    }[how]
    assert ids(lookups.cliente_cuentas(small, asked, ordered=True), "num_cuenta") == ["A2", "A3", "A1"]


def test_goals_with_unknown_date_come_last(small):
    assert ids(lookups.cliente_metas(small, "C1"), "id_meta") == ["M2", "M1"]


def test_latest_transactions(small):
    assert ids(lookups.cliente_transacciones(small, "C1", limit=1), "id_transaccion") == ["T2"]
    assert ids(lookups.cliente_transacciones(small, limit=1), "id_transaccion") == ["T2", "T3"]


def test_fraud_filter_has_three_states(small):
    kept = lambda f: sorted(ids(lookups.transacciones_filtradas(small, fraude=f), "id_transaccion"))
    assert (kept(None), kept(True), kept(False)) == (["T1", "T2", "T3"], ["T1"], ["T2"])


def test_date_bound_is_the_whole_day_and_instant_is_exact(small):
    def kept(**f):
        return sorted(ids(lookups.transacciones_filtradas(small, **f), "id_transaccion"))

    assert kept(desde="2024-01-02", hasta="2024-01-02") == ["T2", "T3"]
    assert kept(hasta=dt.datetime(2024, 1, 2, 8)) == ["T1", "T2"]
    assert kept(desde=dt.datetime(2024, 1, 2, 8, 0, 1)) == ["T3"]


def test_detail(small):
    (one,) = rows_of(lookups.transaccion_detalle(small, "T3"))
    assert (one["nombre"], one["apellido_paterno"]) == ("Luis", "PÉREZ")
    assert rows_of(lookups.transaccion_detalle(small, ["T8"])) == []


def test_pages_put_together_are_the_whole_list(spark):
    t = sample_bank(spark, SAMPLE, timed=True)
    full = [r.id_transaccion for r in
            t.transacciones.filter("canal = 'Web'").orderBy(F.desc("fecha"), "id_transaccion").collect()]
    paged, last = [], None
    for page in range(1, len(full) // 60 + 2):
        rows = lookups.transacciones_list(t, page=page, limit=60, canal="Web").collect()
        if last is not None:
            after = lookups.transacciones_list_after(
                t, fecha=last.fecha, id_transaccion=last.id_transaccion, limit=60, canal="Web"
            ).collect()
            assert after == rows
        paged += [r.id_transaccion for r in rows]
        last = rows[-1] if rows else last
    assert paged == full


def test_ids_as_a_frame_equal_named_ids(spark):
    t = sample_bank(spark, SAMPLE)
    wanted = ["C3", "C12", "C40", "nadie"]
    ids = spark.createDataFrame([(i,) for i in wanted + ["C3"]], "id_cliente string")
    for job in (lookups.cliente_cuentas, lookups.cliente_prestamos, lookups.cliente_tarjetas, lookups.cliente_metas, lookups.cliente_transacciones, lookups.cliente_perfil):
        named, framed = job(t, wanted), job(t, ids)
        assert named.count() > 0
        assert sorted(map(str, named.collect())) == sorted(map(str, framed.collect()))


def test_named_clients_come_sorted(spark):
    t = sample_bank(spark, SAMPLE)
    rows = lookups.cliente_cuentas(t, ["C3", "C12"]).collect()
    key = [(r.id_cliente, -(r.fecha_apertura.toordinal() if r.fecha_apertura else 10**9), r.num_cuenta) for r in rows]
    assert key == sorted(key)
    page = lookups.transacciones_list(t, page=1, limit=30).collect()
    assert [(-r.fecha.timestamp(), r.id_transaccion) for r in page] == sorted((-r.fecha.timestamp(), r.id_transaccion) for r in page)
    clients = lookups.clientes_list(t, page=2, limit=10).collect()
    assert [(r.apellido_paterno, r.id_cliente) for r in clients] == sorted((r.apellido_paterno, r.id_cliente) for r in clients)


def test_latest_beyond_what_spark_trims(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("k"), F.timestamp_seconds("id").alias("at"))
    latest = latest_per_key(df, "k", 1500, "at", F.desc("id"))
    assert latest.count() == 3000
    assert latest.agg(F.min("id")).first()[0] == 2000


def test_latest_rows_with_tied_days_few_rows_and_no_time(spark):
    day = lambda n, s: None if n is None else dt.datetime(2024, 1, n, 0, 0, s)
    rows = [("tied", day(5, 0), i) for i in range(9)] + [("tied", day(6, 1), 9), ("tied", day(4, 1), 10)]
    rows += [("few", day(1, 1), 0), ("few", None, 1)]
    rows += [("timeless", None, i) for i in range(6)] + [("timeless", day(2, 2), 6)]
    rows += [("days", day(d, s), 100 * d + s) for d in range(1, 9) for s in range(2)] + [(None, day(3, 3), 1)]
    df = spark.createDataFrame(rows, "k string, at timestamp, id long")
    got = {}
    for r in latest_per_key(df, "k", 4, "at", F.asc("id")).collect():
        got.setdefault(r.k, set()).add(r.id)
    assert got == {
        "tied": {9, 0, 1, 2}, "few": {0, 1}, "timeless": {6, 0, 1, 2}, "days": {801, 800, 701, 700}, None: {1},
    }
