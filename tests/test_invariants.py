"""Facts that hold whatever the data is."""

from __future__ import annotations

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from caudal.functions.numbers import pct_of_counts
from caudal.functions.text import change_text
from caudal.plans import fraud, kpis
from caudal.sources.sample_bank import sample_bank
from tests.conftest import SAMPLE, rows_of

SHARES = (
    (kpis.kpi_pagos_por_estatus, "pagos", "estatus_pago"),
    (kpis.kpi_pagos_por_canal, "pagos", "canal_pago"),
    (kpis.kpi_seguros_por_estatus, "seguros", "estatus_seguro"),
    (kpis.kpi_notificaciones_por_canal, "notificaciones", "canal_notificacion"),
    (kpis.kpi_metas_ahorro_por_estatus, "metas_ahorro", "estatus"),
)


@pytest.mark.parametrize("kpi,table,column", SHARES)
def test_shares_add_up(spark, kpi, table, column):
    t = sample_bank(spark, SAMPLE)
    rows = rows_of(kpi(t))
    assert abs(sum(r["porcentaje"] for r in rows) - 100) <= 0.005 * len(rows) + 1e-9
    assert sum(r["total"] for r in rows) == t[table].filter(F.col(column).isNotNull()).count()


def test_alerts_are_transactions(spark):
    t = sample_bank(spark, SAMPLE, timed=True)
    alerts = fraud.fraud_alerts(t)
    assert alerts.join(t.transacciones, "id_transaccion", "left_anti").count() == 0
    assert alerts.count() == alerts.select("id_transaccion").distinct().count()
    by_channel = rows_of(fraud.fraud_by_channel(alerts))
    assert sum(r["total_fraudes"] for r in by_channel) == alerts.count()
    assert fraud.score_transactions(t).count() == t.transacciones.count()


def test_periods_next_to_each_other_add_up(spark):
    t = sample_bank(spark, SAMPLE)

    def transactions(desde, hasta):
        return rows_of(kpis.kpi_resumen_periodo(t, desde=desde, hasta=hasta))[0]["transacciones"]

    whole = transactions("1996-01-01", "1996-12-31")
    assert whole == transactions("1996-01-01", "1996-06-30") + transactions("1996-07-01", "1996-12-31")


counts = st.integers(min_value=0, max_value=10**12)


@settings(max_examples=15, deadline=None)
@given(pairs=st.lists(st.tuples(counts, counts), min_size=1, max_size=40))
def test_ratios_round_half_up_exactly(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    rows = df.select(
        "a", "b", pct_of_counts(F.col("a"), F.col("b")).alias("p"),
        change_text(F.col("a"), F.col("b")).alias("c"),
    ).collect()
    for a, b, p, c in rows:
        if b == 0:
            assert p is None and c == ("aumentó 100%" if a > 0 else "sin cambio")
            continue
        assert p == ((2 * 100 * 100 * a + b) // (2 * b)) / 100
        tenths = (2 * 1000 * abs(a - b) + b) // (2 * b)
        assert c == f"{'aumentó' if a >= b else 'bajó'} {tenths // 10}.{tenths % 10}%"
