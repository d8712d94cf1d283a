"""Text rendering, yearly comparisons and the report."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from caudal.functions import text
from caudal.operators.asof import join_as_of
from caudal.operators.periods import best_year, yearly_counts, year_over_year
from caudal.plans import history, report
from caudal.sources.sample_bank import sample_bank
from tests.conftest import SAMPLE, rows_of


def shown(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value,expected", [
    (0.0, "$0 MXN"), (999.4, "$999 MXN"), (1000.0, "$1.0K MXN"), (1250.0, "$1.3K MXN"),
    (-2500000.0, "$-2.50M MXN"), (1234567890.0, "$1.23B MXN"),
])
def test_money_compact(spark, value, expected):
    assert shown(spark, text.money_compact(F.lit(value))) == expected


@pytest.mark.parametrize("now,before,expected", [
    (5, 0, "aumentó 100%"), (0, 0, "sin cambio"), (5, 5, "aumentó 0.0%"),
    (1125, 1000, "aumentó 12.5%"), (1000, 1125, "bajó 11.1%"), (0, 7, "bajó 100.0%"),
    (2009, 2000, "aumentó 0.5%"),
])
def test_change_text(spark, now, before, expected):
    assert shown(spark, text.change_text(F.lit(now), F.lit(before))) == expected


def test_other_texts(spark):
    assert shown(spark, text.thousands(F.lit(1234567))) == "1,234,567"
    assert shown(spark, text.money(F.lit(1234.5))) == "$1,234.50"
    assert shown(spark, text.percent(F.lit(12.3))) == "12.30%"
    assert shown(spark, text.percent(F.lit(None).cast("double"))) == "0.00%"
    assert [shown(spark, text.plain_number(F.lit(v))) for v in (0.0, 20.0, 9.5, 3.27, 100.0)] == [
        "0", "20", "9.5", "3.27", "100",
    ]
    assert shown(spark, text.name_at(text.MESES, F.lit(12))) == "Diciembre"
    assert shown(spark, text.month_of_label(F.lit("2024-07"))) == "07"


@pytest.fixture
def dated(frame):
    def make(*years):
        return frame("cuentas", [{"num_cuenta": str(i), "fecha_apertura": dt.date(y, 12, 31)}
                                 for i, y in enumerate(years)])
    return make


def test_year_gaps_count_as_zero(dated):
    counts = yearly_counts(dated(2021, 2021, 2023), "fecha_apertura", [2021, 2022, 2023], {"m": F.lit(True)})
    assert [(r["anio"], r["valor"], r["previo"], r["texto"]) for r in rows_of(year_over_year(counts))] == [
        (2022, 0, 2, "bajó 100.0%"), (2023, 1, 0, "aumentó 100%"),
    ]


def test_earliest_year_wins_a_tie(dated):
    years = [2021, 2022, 2023]
    tied = yearly_counts(dated(2022, 2023), "fecha_apertura", years, {"m": F.lit(True)})
    assert rows_of(best_year(tied)) == [{"metrica": "m", "anio": 2022, "valor": 1}]
    empty = yearly_counts(dated(), "fecha_apertura", years, {"m": F.lit(True)})
    assert rows_of(best_year(empty)) == [{"metrica": "m", "anio": 2021, "valor": 0}]


def test_separate_years(dated, bank):
    t = bank(cuentas=rows_of(dated(2020, 2021, 2022)))
    found = rows_of(history.ctx_cuentas_anual(t, years=[2020, 2022]))
    assert found == [{"anio": 2020, "nuevas": 1}, {"anio": 2022, "nuevas": 1}]


def test_as_of_rates(spark):
    quotes = spark.createDataFrame(
        [(dt.date(2024, 1, 5), D("10.0000")), (dt.date(2024, 1, 5), D("11.0000")),
         (dt.date(2024, 1, 8), D("20.0000")), (dt.date(2024, 1, 9), None)],
        "dia date, valor decimal(10,4)",
    )
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (4, 5, 7, 8, 9, 30)], "d date")
    found = {r["d"].day: r["valor"] for r in rows_of(join_as_of(days, F.col("d"), quotes, "dia", "valor"))}
    assert found == {4: None, 5: D("11.0000"), 7: D("11.0000"), 8: D("20.0000"), 9: D("20.0000"),
                     30: D("20.0000")}


def test_report_sections_can_be_turned_off(spark):
    t = sample_bank(spark, SAMPLE)
    only = report.rep_reporte(t, kpis_on=False, graficas=False, recomendaciones=False)
    assert {r["seccion"] for r in rows_of(only)} == {"fraude", "debilidades"}
    with pytest.raises(ValueError):
        report.rep_reporte(t, kpis_on=False, fraude=False, graficas=False, debilidades=False,
                           recomendaciones=False)


def test_report_of_an_empty_bank(bank):
    rows = rows_of(report.rep_reporte(bank()))
    assert {"seccion": "recomendaciones", "bloque": "Soluciones Recomendadas", "etiqueta": None,
            "texto": report.SIN_SOLUCIONES} in rows
    assert {"seccion": "fraude", "bloque": "Análisis de Fraude Potencial", "etiqueta": "BAJO",
            "texto": report.MENSAJE_BAJO} in rows


@pytest.mark.parametrize("frauds,level", [(5, "MEDIO"), (6, "ALTO"), (2, "BAJO"), (3, "MEDIO")])
def test_fraud_levels(bank, frauds, level):
    t = bank(transacciones=[{"es_fraude_potencial": i < frauds} for i in range(100)])
    (row,) = rows_of(report.rep_nivel_fraude(t))
    assert (row["nivel"], row["fraudesPotenciales"]) == (level, frauds)
