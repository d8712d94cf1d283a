"""The stored daily aggregate: refreshes, and the plans it answers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from caudal.plans import daily, history, kpis, report
from tests.conftest import plan_of, rows_of

START = dt.datetime(2022, 11, 3, 0, 30)


def some(n, first=0):
    return [
        {"id_transaccion": f"t{i}", "id_cliente": f"c{i % 5}", "monto": None if i % 13 == 0 else Decimal(i) / 100,
         "canal": None if i % 17 == 0 else f"canal{i % 3}", "categoria": f"cat{i % 4}",
         "es_fraude_potencial": None if i % 7 == 0 else i % 5 == 0,
         "fecha": None if i % 61 == 0 else START + dt.timedelta(hours=7 * i)}
        for i in range(first, n)
    ]


def as_set(df):
    return sorted(map(repr, df.collect()))


def test_a_refresh_adds_new_days_only(spark, frame, tmp_path, monkeypatch):
    folder = str(tmp_path)
    assert daily.stored_daily(spark, folder).isEmpty()
    read = []
    plain = daily.daily_volume
    monkeypatch.setattr(daily, "daily_volume", lambda tx: read.append(tx.count()) or plain(tx))
    for n in (200, 201, 400, 400):
        tx = frame("transacciones", some(n))
        daily.refresh_daily(spark, tx, folder)
        assert as_set(daily.stored_daily(spark, folder)) == as_set(plain(tx))
    assert read[0] == 200 and max(read[1], read[3]) < 20 and read[2] < 220


def test_late_rows_and_a_refresh_that_was_cut_off(spark, frame, tmp_path, monkeypatch):
    folder = str(tmp_path)
    daily.refresh_daily(spark, frame("transacciones", some(300)), folder)
    late = [{"id_transaccion": "x", "canal": "canal1", "monto": Decimal(5), "fecha": START + dt.timedelta(days=40)}]
    tx = frame("transacciones", some(300) + late)
    before = as_set(daily.stored_daily(spark, folder))
    with monkeypatch.context() as m:
        m.setattr(daily, "commit_load", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            daily.refresh_daily(spark, tx, folder, full=True)
    assert as_set(daily.stored_daily(spark, folder)) == before
    daily.refresh_daily(spark, tx, folder)
    assert as_set(daily.stored_daily(spark, folder)) == before
    daily.refresh_daily(spark, tx, folder, desde=(START + dt.timedelta(days=30)).date())
    assert as_set(daily.stored_daily(spark, folder)) == as_set(daily.daily_volume(tx))
    daily.refresh_daily(spark, frame("transacciones", some(10)), folder, full=True)
    assert as_set(daily.stored_daily(spark, folder)) == as_set(daily.daily_volume(frame("transacciones", some(10))))


@pytest.mark.parametrize("as_of", [None, "2023-10-05 11:45:00"])
def test_plans_give_the_same_from_days(spark, bank, tmp_path, as_of):
    t = bank(transacciones=some(1400))
    daily.refresh_daily(spark, t.transacciones, str(tmp_path))
    days = daily.stored_daily(spark, str(tmp_path))
    plans = [
        (kpis.kpi_transacciones_por_categoria, {}), (kpis.kpi_transacciones_por_canal, {}),
        (kpis.kpi_tendencia, {"as_of": as_of}), (kpis.kpi_canal_periodo, {"desde": "2023-01-02", "hasta": "2023-02-11"}),
        (history.ctx_tx_anual, {"years": [2022, 2023]}), (history.ctx_tx_trimestral, {"years": [2022, 2023]}),
        (history.ctx_tx_mensual, {"years": [2023]}), (report.rep_series, {"as_of": as_of}),
        (report.rep_reporte, {"as_of": as_of}),
    ]
    for plan, params in plans:
        assert as_set(plan(t, diario=days, **params)) == as_set(plan(t, **params)), plan.__name__


def test_plans_from_days_leave_the_transactions_alone(spark, bank, tmp_path):
    t = bank(transacciones=some(50))
    days = daily.daily_volume(t.transacciones)
    days.write.parquet(str(tmp_path / "d"))
    days = spark.read.parquet(str(tmp_path / "d"))
    for plan in (kpis.kpi_transacciones_por_canal, history.ctx_tx_anual):
        assert "id_transaccion" not in plan_of(plan(t, diario=days))
        assert "LocalTableScan" not in plan_of(plan(t, diario=days))
    assert len(rows_of(kpis.kpi_transacciones_por_canal(t, diario=days))) == 3
