"""Scoring rules on hand-made transactions."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from caudal.functions.geo import haversine_km
from caudal.plans import fraud, fraud_mart
from caudal.schemas import MART_DDL
from caudal.sources.sample_bank import sample_bank
from tests.conftest import SAMPLE, rows_of

NOON = dt.datetime(2024, 3, 6, 12, 0)


def tx(i, client="C1", at=NOON, **more):
    return {"id_transaccion": f"T{i}", "id_cliente": client, "fecha": at, "monto": D("10.00"), **more}


def flags(df, name):
    return {r["id_transaccion"]: r[name] for r in rows_of(df)}


def place(lat, lon):
    return {"latitud": D(lat), "longitud": D(lon)}


HOME = {"id_cliente": "C1", "latitud_habitual": D("19.000000"), "longitud_habitual": D("-99.000000")}


def test_distance_limit(bank):
    # One degree of latitude is 111.19 km.
    t = bank(
        datos_personales=[HOME],
        transacciones=[
            tx(1, **place("19.899000", "-99.000000")),
            tx(2, **place("19.900000", "-99.000000")),
            tx(3, latitud=D("25.000000")),
            tx(4, "C2", **place("25.000000", "-99.000000")),
        ],
    )
    assert flags(fraud.fraud_r1_geo(t), "r1_geo") == {"T1": False, "T2": True, "T3": False, "T4": False}


def test_haversine_of_antipodes(spark):
    point = spark.range(1).select(haversine_km(F.lit(0), F.lit(0), F.lit(0), F.lit(180)).alias("km"))
    assert point.first().km == pytest.approx(20015.09, abs=0.01)


def test_amount_rule_needs_a_deviation(bank):
    usual = [tx(i, monto=D("10.00") + i % 3) for i in range(30)]
    t = bank(transacciones=[
        *usual, tx(30, monto=D("500.00")), tx(31, monto=D("-500.00")), tx(32, monto=None),
        tx(40, "C2", monto=D("9999.00")),
        tx(50, "C3", monto=D("5.00")), tx(51, "C3", monto=D("5.00")),
    ])
    found = flags(fraud.fraud_r3_amount(t), "r3_monto")
    assert [k for k, v in found.items() if v] == ["T30"]


@pytest.mark.parametrize("clock,odd", [
    ((0, 59, 59), False), ((1, 0, 0), True), ((4, 59, 59), True), ((5, 0, 0), False),
])
def test_small_hours(bank, clock, odd):
    t = bank(transacciones=[tx(1, at=dt.datetime(2024, 3, 6, *clock))])
    assert flags(fraud.fraud_r4_hour(t), "r4_hora") == {"T1": odd}


@pytest.fixture
def fraud_bank(bank):
    night = dt.datetime(2024, 3, 9, 2, 0)  # a Saturday
    return bank(
        clientes=[
            {"id_cliente": "C1", "nombre": "Ana", "apellido_paterno": "Ruiz"},
            {"id_cliente": "C2", "nombre": "Luis", "apellido_paterno": "Soto"},
        ],
        datos_personales=[HOME],
        cuentas=[{"num_cuenta": "A1", "id_cliente": "C1", "tipo_cuenta": "Ahorro", "sucursal": "S1"}],
        tipo_cambio=[
            {"fecha": dt.date(2024, 3, 7), "rate": D("16.0000")},
            {"fecha": dt.date(2024, 3, 8), "rate": D("20.0000")},
        ],
        transacciones=[
            tx(1, at=NOON, num_cuenta="A1", canal="App", **place("25.000000", "-99.000000")),
            tx(2, at=night, num_cuenta="A1", canal="Web", **place("25.000000", "-99.000000")),
            # C2: four within the hour at night (R2 + R4), then one alone (R4 only).
            *[tx(10 + i, "C2", at=night + dt.timedelta(minutes=i), canal="Web") for i in range(4)],
            tx(20, "C2", at=dt.datetime(2024, 3, 5, 3, 0), canal="Web"),
            tx(30, "C9", at=night, **place("25.000000", "-99.000000")),
        ],
    )


def test_alerts_score_and_enrichment(fraud_bank):
    found = {r["id_transaccion"]: r for r in rows_of(fraud.fraud_alerts(fraud_bank))}
    assert {k: r["score"] for k, r in found.items()} == {"T1": 3, "T2": 4, "T13": 3}
    assert (found["T1"]["nombre"], found["T1"]["tipo_cuenta"]) == ("Ana", "Ahorro")
    # Before the first rate there is none; Saturday takes Friday's.
    assert found["T1"]["monto_usd"] is None
    assert found["T2"]["tipo_cambio"] == D("20.0000") and found["T2"]["monto_usd"] == D("0.50")
    assert found["T13"]["sucursal"] is None


def test_mart_of_alerts(fraud_bank):
    alerts = fraud.fraud_alerts(fraud_bank)
    assert rows_of(fraud.fraud_by_channel(alerts)) == [
        {"canal": "Web", "total_fraudes": 2, "porcentaje": 66.67},
        {"canal": "App", "total_fraudes": 1, "porcentaje": 33.33},
    ]
    instants = fraud.client_instants(fraud_bank.transacciones)
    (summary,) = rows_of(fraud.fraud_summary(alerts, instants))
    assert summary["total_transacciones"] == 8 and summary["tasa_fraude_pct"] == 37.5
    assert summary["monto_total_usd"] == 1.0


def test_no_transactions_at_all(bank):
    t = bank()
    (summary,) = rows_of(
        fraud.fraud_summary(fraud.fraud_alerts(t), fraud.client_instants(t.transacciones))
    )
    assert summary["total_fraudes"] == 0 and summary["tasa_fraude_pct"] is None


def test_stored_instants_give_the_same_alerts(spark, tmp_path):
    t = sample_bank(spark, SAMPLE, timed=True)
    plain = fraud.fraud_alerts(t)
    fraud.client_instants(t.transacciones).write.parquet(str(tmp_path / "i"))
    stored = fraud.fraud_alerts(t, instants=spark.read.parquet(str(tmp_path / "i")))
    assert plain.count() > 0
    assert plain.exceptAll(stored).count() == 0 and stored.exceptAll(plain).count() == 0


def test_every_rule_fires_on_the_sample(spark):
    scored = fraud.score_transactions(sample_bank(spark, SAMPLE, timed=True))
    fired = scored.agg(*[
        F.count_if(F.col(c)).alias(c) for c in ("r1_geo", "r2_velocidad", "r4_hora")
    ]).first()
    assert all(n > 0 for n in fired)


def test_right_sides_are_unique(spark):
    """The joins of the score take one row per client and account for granted."""
    t = sample_bank(spark, SAMPLE, timed=True)
    for name, key in (("clientes", "id_cliente"), ("datos_personales", "id_cliente"), ("cuentas", "num_cuenta")):
        assert t[name].count() == t[name].select(key).distinct().count()


def test_deviation_is_exact_and_never_negative(frame):
    amounts = ["0.10"] * 7 + ["1000000000.01"] * 3
    rows = [{"id_transaccion": f"T{i}", "id_cliente": "a" if i % 2 else "b", "fecha": None, "monto": D(m)} for i, m in enumerate(amounts)]
    rows += [{"id_transaccion": f"S{i}", "id_cliente": "c", "monto": D("0.10")} for i in range(9)]
    rows += [{"id_transaccion": "U", "id_cliente": "d", "monto": D("5.00")}, {"id_transaccion": "V", "id_cliente": "e"}]
    profile = {r["id_cliente"]: r for r in rows_of(fraud.amount_profile(fraud.client_instants(frame("transacciones", rows))))}
    assert profile["c"]["desviacion"] == pytest.approx(0, abs=1e-9)
    assert profile["d"]["desviacion"] is None and "e" not in profile
    import statistics
    own = [float(r["monto"]) for r in rows if r["id_cliente"] == "a"]
    assert profile["a"]["desviacion"] == pytest.approx(statistics.stdev(own), rel=1e-9)


def test_load_can_be_repeated(spark, tmp_path):
    t = sample_bank(spark, SAMPLE, timed=True)
    folder = str(tmp_path / "mart")
    first = fraud.etl_run(spark, t, folder, staging=str(tmp_path / "copy"))
    before = rows_of(fraud_mart.etl_resumen(fraud_mart.mart_views(spark)))
    with_first = fraud_mart.mart_views(spark)["alertas_fraude"]
    rows = with_first.count()
    second = fraud.etl_run(spark, t, folder)
    # A new folder each time: who still reads the load before is not disturbed.
    assert set(second) == set(first) and not set(second.values()) & set(first.values())
    assert with_first.count() == rows
    mart = fraud_mart.mart_views(spark)
    assert rows_of(fraud_mart.etl_resumen(mart)) == before
    assert set(first) == set(MART_DDL)

    total = before[0]["total_fraudes"]
    ordered = [r.id_transaccion for r in
               mart["alertas_fraude"].orderBy(F.desc("fecha"), "id_transaccion").collect()]
    paged = []
    for page in range(1, total // 20 + 2):
        paged += [r.id_transaccion for r in
                  fraud_mart.etl_alertas_fraude(mart, page=page, limit=20).collect()]
    assert paged == ordered and len(ordered) == total
    last = fraud_mart.etl_alertas_fraude(mart, page=1, limit=20).collect()[-1]
    after = fraud_mart.etl_alertas_fraude_after(
        mart, fecha=last.fecha, id_transaccion=last.id_transaccion, limit=20
    )
    assert [r.id_transaccion for r in after.collect()] == ordered[20:40]


def test_views_before_the_first_load(spark):
    for name in MART_DDL:
        spark.catalog.dropTempView(f"dwh_{name}")
    mart = fraud_mart.mart_views(spark)
    assert fraud_mart.etl_resumen(mart).collect() == []
    assert fraud_mart.etl_fraude_por_canal(mart).columns == ["canal", "total_fraudes", "porcentaje"]


def test_geographic_cells_break_mode_ties_by_name(bank):
    cell = place("19.040000", "-99.010000")
    t = bank(transacciones=[
        tx(1, es_fraude_potencial=True, categoria="Ropa", canal="Web", **cell),
        tx(2, es_fraude_potencial=True, categoria="Hogar", canal=None, **cell),
        tx(3, es_fraude_potencial=None, categoria="Ropa", canal="Web", **cell),
    ])
    (row,) = rows_of(fraud_mart.etl_fraude_geografico(t))
    assert (row["lat"], row["lng"], row["total_fraudes"]) == (19.0, -99.0, 2)
    assert (row["categoria_top"], row["canal_top"]) == ("Hogar", "Web")


def test_merchants_tied_at_the_limit_come_by_name(bank):
    rows = [tx(i, es_fraude_potencial=True, comercio=f"M{i % 3}", categoria="X") for i in range(6)]
    found = rows_of(fraud_mart.etl_fraude_por_comercio(bank(transacciones=rows), k=2))
    assert [r["comercio"] for r in found] == ["M0", "M1"]
    assert found[0]["clientes_afectados"] == 1


def test_flagged_amount_of_an_empty_period_is_null(bank):
    t = bank(transacciones=[tx(1, es_fraude_potencial=False)])
    (row,) = rows_of(fraud_mart.etl_resumen_periodo(t, desde="2024-03-06", hasta="2024-03-06"))
    assert row == {"total_fraudes": 0, "monto_total": None, "tasa_fraude": 0.0}
