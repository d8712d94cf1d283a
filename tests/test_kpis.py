"""KPI rules on hand-made rows: NULLs, thresholds, edges and ties."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from caudal.plans import kpis
from tests.conftest import rows_of


def many(n, **row):
    return [dict(row) for _ in range(n)]


def test_summary_of_an_empty_bank(bank):
    (row,) = rows_of(kpis.kpi_resumen(bank()))
    assert set(row.values()) == {0}


def test_summary(bank):
    t = bank(
        clientes=[{"id_cliente": f"C{i}"} for i in range(3)],
        cuentas=[
            {"num_cuenta": "1", "estatus": "Activa", "saldo": D("10.50")},
            {"num_cuenta": "2", "estatus": "Activa", "saldo": None},
            {"num_cuenta": "3", "estatus": "Cancelada", "saldo": D("99.00")},
        ],
        prestamos=[{"id_prestamo": "1", "estatus_prestamo": "Vigente", "saldo_prestamo": D("7.00")}],
        transacciones=[
            {"id_transaccion": "1", "fecha": dt.datetime(2024, 5, 1, 23, 59), "es_fraude_potencial": True},
            {"id_transaccion": "2", "fecha": dt.datetime(2024, 5, 2, 0, 0), "es_fraude_potencial": None},
            {"id_transaccion": "3", "fecha": dt.datetime(2024, 5, 2, 18, 0), "es_fraude_potencial": True},
        ],
        cobros=[{"id_cobro": "1", "excede_limite": True}, {"id_cobro": "2", "excede_limite": None}],
    )
    (row,) = rows_of(kpis.kpi_resumen(t))
    assert row == {
        "totalClientes": 3, "cuentasActivas": 2, "saldoTotalCuentas": 10.5, "prestamosActivos": 1,
        "montoPrestamosVigentes": 7.0, "transaccionesHoy": 2, "fraudesPotenciales": 2,
        "cobrosExcedidos": 1,
    }


def test_shares_leave_null_groups_out(bank):
    t = bank(pagos=[*many(2, estatus_pago="A"), *many(1, estatus_pago="B"), *many(5, estatus_pago=None)])
    assert rows_of(kpis.kpi_pagos_por_estatus(t)) == [
        {"estatus": "A", "total": 2, "porcentaje": 66.67},
        {"estatus": "B", "total": 1, "porcentaje": 33.33},
    ]


def test_share_on_the_rounding_edge(bank):
    # 669 / 4000 = 16.725 %, which a double holds as slightly less.
    t = bank(pagos=[*many(669, canal_pago="A"), *many(3331, canal_pago="B")])
    assert {r["canal"]: r["porcentaje"] for r in rows_of(kpis.kpi_pagos_por_canal(t))} == {
        "A": 16.73, "B": 83.28,
    }


def test_score_bucket_edges(bank):
    scores = [499, 500, 649, 650, 749, 750, None]
    t = bank(open_data=[{"id_cliente": str(i), "score_crediticio": s} for i, s in enumerate(scores)])
    assert [(r["rango"], r["total"]) for r in rows_of(kpis.kpi_score_crediticio(t))] == [
        ("Malo (< 500)", 1), ("Regular (500-649)", 2), ("Bueno (650-749)", 2), ("Excelente (750+)", 1),
    ]


def test_null_fee_type_is_kept_and_null_flags_stay_in_the_denominator(bank):
    t = bank(
        auditoria_comisiones=[
            {"resultado": "Excede", "tipo_comision": None, "diferencia": D("5.00")},
            {"resultado": "Excede", "tipo_comision": "X", "diferencia": D("4.00")},
            {"resultado": "Correcto", "tipo_comision": "X", "diferencia": D("9.00")},
        ],
        cobros=[{"excede_limite": True}, {"excede_limite": None}, {"excede_limite": False}],
    )
    assert [r["tipo"] for r in rows_of(kpis.kpi_cobros_excedidos(t))] == [None, "X"]
    (risk,) = rows_of(kpis.kpi_debilidades(t))
    assert risk["porcentajeCobrosExcedidos"] == 33.33


def risky(bank, over):
    """A bank exactly at every threshold, or just above."""
    return bank(
        transacciones=[*many(5 + over, es_fraude_potencial=True), *many(95 - over, es_fraude_potencial=False)],
        cobros=[*many(10 + over, excede_limite=True), *many(90 - over, excede_limite=False)],
        cuentas=[*many(20 + over, estatus="Cancelada"), *many(80 - over, estatus="Activa")],
        prestamos=[
            *many(15 + over, estatus_prestamo="Vencido"), *many(85 - over, estatus_prestamo="Vigente"),
            *many(40, estatus_prestamo="Liquidado"), *many(7, estatus_prestamo=None),
        ],
        metas_ahorro=[*many(30 + over, estatus="Fallida"), *many(70 - over, estatus="Activa")],
    )


def test_thresholds_are_strict(bank):
    (risk,) = rows_of(kpis.kpi_debilidades(risky(bank, 0)))
    assert list(risk.values()) == [5.0, 10.0, 20.0, 15.0, 30.0]
    assert rows_of(kpis.kpi_soluciones(risky(bank, 0))) == []


def test_recommendations_above_the_thresholds(bank):
    found = rows_of(kpis.kpi_soluciones(risky(bank, 1)))
    assert [(r["area"], r["prioridad"]) for r in found] == [
        ("Seguridad", "Alta"), ("Cumplimiento", "Alta"), ("Retención", "Media"),
        ("Cartera", "Alta"), ("Ahorro", "Baja"),
    ]
    assert found[0]["problema"] == "6% de transacciones con riesgo de fraude"


def test_one_row_holds_both_summaries(bank):
    t = risky(bank, 1)
    (both,) = rows_of(kpis.resumen_y_debilidades(t))
    (a,), (b,) = rows_of(kpis.kpi_resumen(t)), rows_of(kpis.kpi_debilidades(t))
    assert both == {**a, **b}


def test_mean_of_ratios_is_not_ratio_of_sums(bank):
    def card(limit, balance, status="Activa"):
        return {"tipo_tarjeta": "Oro", "estatus_tarjeta": status,
                "limite_credito": D(limit), "saldo_tarjeta": D(balance)}

    t = bank(tarjetas=[card("100.00", "90.00"), card("1000.00", "100.00"), card("0.00", "50.00"),
                       card("10.00", "10.00", "Bloqueada")])
    (by_type,) = rows_of(kpis.kpi_utilizacion_credito(t))
    (overall,) = rows_of(kpis.kpi_utilizacion_credito_resumen(t))
    assert by_type["utilizacion_promedio"] == 50.0 and by_type["total_tarjetas"] == 2
    assert overall["utilizacion_global"] == 17.27
    (late,) = rows_of(kpis.kpi_morosidad_tarjetas(t))
    assert (late["total"], late["morosas"], late["tasa_morosidad"]) == (4, 1, 25.0)


def test_ratios_of_empty_tables_are_null(bank):
    t = bank()
    assert rows_of(kpis.kpi_utilizacion_credito_resumen(t))[0]["utilizacion_global"] is None
    assert rows_of(kpis.kpi_nomina_resumen(t))[0]["porcentaje_penetracion"] is None
    assert rows_of(kpis.kpi_prima_anual(t))[0] == {
        "prima_promedio": None, "prima_total": None, "total_polizas": 0,
    }


def test_payroll_null_counts_as_without(bank):
    t = bank(datos_negocio=[{"paga_nomina": True}, {"paga_nomina": False}, {"paga_nomina": None}])
    (row,) = rows_of(kpis.kpi_nomina_resumen(t))
    assert (row["con_nomina"], row["sin_nomina"], row["porcentaje_penetracion"]) == (1, 2, 33.33)


def test_branches_tied_at_the_limit_come_by_name(bank):
    t = bank(cuentas=[{"sucursal": s} for s in ("S3", "S1", "S2", "S1", None)])
    assert [r["sucursal"] for r in rows_of(kpis.kpi_cuentas_por_sucursal(t, k=2))] == ["S1", "S2"]


def test_trend_starts_at_the_instant(bank):
    t = bank(transacciones=[
        {"fecha": dt.datetime(2024, 3, 15, 12, 0), "monto": D("1.00")},
        {"fecha": dt.datetime(2023, 3, 15, 12, 0), "monto": D("2.00")},
        {"fecha": dt.datetime(2023, 3, 15, 11, 59), "monto": D("4.00")},
    ])
    assert [(r["mes"], r["monto_total"]) for r in rows_of(kpis.kpi_tendencia(t))] == [
        ("2023-03", 2.0), ("2024-03", 1.0),
    ]
    assert rows_of(kpis.kpi_tendencia(t, as_of="2030-01-01 00:00:00")) == []


@pytest.fixture
def period_bank(bank):
    day = dt.date(2024, 1, 31)
    return bank(
        clientes=[{"id_cliente": "C1"}, {"id_cliente": "C2"}],
        cuentas=[
            {"num_cuenta": "1", "id_cliente": "C1", "estatus": "Activa", "saldo": D("3.00"), "fecha_apertura": day},
            {"num_cuenta": "2", "id_cliente": "C1", "estatus": "Activa", "saldo": D("4.00"),
             "fecha_apertura": dt.date(2020, 1, 1)},
            {"num_cuenta": "3", "id_cliente": "C2", "estatus": "Activa", "saldo": D("5.00"),
             "fecha_apertura": dt.date(2024, 2, 1)},
            {"num_cuenta": "4", "id_cliente": "C2", "estatus": "Activa", "saldo": D("6.00")},
        ],
        transacciones=[
            {"fecha": dt.datetime(2024, 1, 31, 23, 59, 59, 500000), "monto": D("1.00"), "canal": "App"},
            {"fecha": dt.datetime(2024, 2, 1), "monto": D("9.00"), "canal": "App"},
            {"fecha": dt.datetime(2024, 1, 1), "monto": None, "canal": None, "es_fraude_potencial": True},
        ],
        prestamos=[
            {"tipo_prestamo": None, "estatus_prestamo": "Vigente", "saldo_prestamo": D("8.00"), "fecha_otorgamiento": day},
        ],
    )


PERIOD = {"desde": "2024-01-01", "hasta": "2024-01-31"}


def test_period_covers_the_whole_last_day(period_bank):
    (row,) = rows_of(kpis.kpi_resumen_periodo(period_bank, **PERIOD))
    assert row == {
        "totalClientes": 1, "cuentasActivas": 2, "saldoTotalCuentas": 7.0, "transacciones": 2,
        "montoTransacciones": 1.0, "fraudesPotenciales": 1, "cobrosExcedidos": 0,
        "prestamosActivos": 1, "montoPrestamos": 8.0,
    }
    assert rows_of(kpis.kpi_canal_periodo(period_bank, **PERIOD)) == [
        {"canal": "App", "total": 1, "monto_total": 1.0}
    ]


def test_new_clients_and_untyped_loans(period_bank):
    assert rows_of(kpis.kpi_clientes_nuevos(period_bank, **PERIOD)) == [{"nuevos": 1}]
    assert rows_of(kpis.kpi_prestamos_periodo(period_bank, **PERIOD)) == [
        {"tipoPrestamo": None, "total": 1, "saldo_total": 8.0}
    ]
