"""Year, quarter and month series over the bank's tables (C01-C20).

Year lists are parameters. Defaults are the years the dashboards were made for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caudal.functions.numbers import as_double, count_true, mean_of, pct_of_counts
from caudal.functions.text import (
    MESES, TRIMESTRES, like_ci, money_compact, name_at, percent, thousands,
)
from caudal.operators.grouping import count_by, one_row, unpivot_row
from caudal.operators.periods import (
    best_year, compare_two_years, stack, year_over_year, yearly, yearly_by, yearly_counts,
)
from caudal.operators.ranking import top_k
from caudal.plans import kpis
from caudal.sources.tables import Tables

# Years, fuzzy status patterns, short labels and verdicts.
ANIOS_OPERACIONES = (2022, 2023, 2024)
ANIOS_PRODUCTOS = (2021, 2022, 2023)
PAGO_EXITOSO = "%exit%"
META_COMPLETADA = "%complet%"
META_FALLIDA = "%fall%"
SCORE_LABELS_CORTAS = ("Malo", "Regular", "Bueno", "Excelente")
EN_RIESGO = "EN RIESGO"
DENTRO_DEL_LIMITE = "DENTRO DEL LÍMITE"

Years = tuple[int, ...] | list[int]

def _count(name: str = "total") -> Column:
    return F.count("*").alias(name)


def _whole_sum(value: str, name: str) -> Column:
    return as_double(F.round(F.sum(value), 0)).alias(name)


# ── snapshot and yearly series ──────────────────────────────────────────────────────────

def ctx_snapshot(t: Tables) -> DataFrame:
    """Ten global counts and balances; one scan per table."""
    return one_row(
        t.clientes.agg(F.count("*").alias("totalClientes")),
        t.cuentas.agg(*kpis.account_totals()),
        t.prestamos.agg(*kpis.loan_totals()),
        t.transacciones.agg(count_true(F.col("es_fraude_potencial")).alias("fraudesPotenciales")),
        t.cobros.agg(kpis.over_limit_fees()),
        t.tarjetas.agg(
            count_true(F.col("estatus_tarjeta") == kpis.TARJETA_ACTIVA).alias("tarjetasActivas")
        ),
        t.seguros.agg(
            count_true(F.col("estatus_seguro") == kpis.SEGURO_ACTIVO).alias("segurosActivos")
        ),
        t.metas_ahorro.agg(
            count_true(F.col("estatus").isin(*kpis.METAS_EN_CURSO)).alias("metasActivas")
        ),
    )


def _transactions(t: Tables, diario: DataFrame | None) -> tuple[DataFrame, str, Column, Column]:
    """What to add up, its date, and the sums that count rows and frauds: the transactions, or
    their stored daily aggregate if one is given."""
    if diario is None:
        return t.transacciones, "fecha", F.count("*"), count_true(F.col("es_fraude_potencial"))
    return diario, "dia", F.sum("n"), F.sum("fraudes")


def ctx_tx_anual(
    t: Tables, *, years: Years = ANIOS_OPERACIONES, diario: DataFrame | None = None
) -> DataFrame:
    rows, on, n, frauds = _transactions(t, diario)
    return yearly(
        rows, on, years,
        n.alias("tx"), _whole_sum("monto", "monto"), frauds.alias("fraudes"),
        pct_of_counts(frauds, n).alias("tasa"),
    )


def ctx_tx_anual_texto(t: Tables, *, years: Years = ANIOS_OPERACIONES) -> DataFrame:
    """The yearly transaction figures as they are shown to a reader."""
    return ctx_tx_anual(t, years=years).select(
        "anio",
        thousands(F.col("tx")).alias("tx"),
        money_compact(F.col("monto")).alias("monto"),
        thousands(F.col("fraudes")).alias("fraudes"),
        percent(F.col("tasa")).alias("tasa"),
    )


def ctx_cuentas_anual(t: Tables, *, years: Years = ANIOS_PRODUCTOS) -> DataFrame:
    return yearly(t.cuentas, "fecha_apertura", years, _count("nuevas"))


def ctx_pagos_anual(t: Tables, *, years: Years = ANIOS_OPERACIONES) -> DataFrame:
    done = count_true(like_ci(F.col("estatus_pago"), PAGO_EXITOSO))
    return yearly(
        t.pagos, "fecha_pago", years,
        _count(), _whole_sum("monto_pago", "monto"), done.alias("exitosos"),
    )


def ctx_prestamos_anual(t: Tables, *, years: Years = ANIOS_PRODUCTOS) -> DataFrame:
    overdue = count_true(F.col("estatus_prestamo") == kpis.PRESTAMO_VENCIDO)
    return yearly(
        t.prestamos, "fecha_otorgamiento", years,
        _count(), _whole_sum("monto_prestamo", "monto"), overdue.alias("vencidos"),
    )


def ctx_seguros_anual(t: Tables, *, years: Years = ANIOS_PRODUCTOS) -> DataFrame:
    return yearly(t.seguros, "fecha_inicio", years, _count())


def ctx_metas_anual(t: Tables, *, years: Years = ANIOS_OPERACIONES) -> DataFrame:
    return yearly(
        t.metas_ahorro, "fecha_inicio", years,
        _count(),
        count_true(like_ci(F.col("estatus"), META_COMPLETADA)).alias("completadas"),
        count_true(like_ci(F.col("estatus"), META_FALLIDA)).alias("fallidas"),
    )


def ctx_cobros_anual(t: Tables, *, years: Years = ANIOS_OPERACIONES) -> DataFrame:
    over = count_true(F.col("excede_limite"))
    return yearly(t.cobros, "fecha_cobro", years, _count(), over.alias("excedidos"))


# ── quarterly and monthly series ────────────────────────────────────────────────────────

def ctx_tx_trimestral(
    t: Tables, *, years: Years = ANIOS_OPERACIONES[1:], diario: DataFrame | None = None
) -> DataFrame:
    rows, on, n, frauds = _transactions(t, diario)
    return yearly_by(
        rows, on, years, "q", F.quarter(on), n.alias("tx"), frauds.alias("fraudes")
    )


def ctx_cuentas_trimestral(t: Tables, *, years: Years = ANIOS_PRODUCTOS[1:]) -> DataFrame:
    on = "fecha_apertura"
    return yearly_by(t.cuentas, on, years, "q", F.quarter(on), _count("nuevas"))


def ctx_tx_mensual(
    t: Tables, *, years: Years = ANIOS_OPERACIONES[1:], diario: DataFrame | None = None
) -> DataFrame:
    rows, on, n, frauds = _transactions(t, diario)
    return yearly_by(
        rows, on, years, "mes", F.month(on), n.alias("tx"), frauds.alias("fraudes")
    )


# ── current breakdowns ──────────────────────────────────────────────────────────────────

def ctx_prestamos_por_tipo(t: Tables) -> DataFrame:
    """All loans by type, whatever their status."""
    return (
        t.prestamos.filter(F.col("tipo_prestamo").isNotNull())
        .groupBy(F.col("tipo_prestamo").alias("tipo"))
        .agg(
            _count(),
            _whole_sum("saldo_prestamo", "saldo"),
            mean_of(F.col("tasa_prestamo")).alias("tasa"),
            count_true(F.col("estatus_prestamo") == kpis.PRESTAMO_VENCIDO).alias("vencidos"),
        )
        .orderBy(F.desc_nulls_first("saldo"), "tipo")
    )


def ctx_top5_sucursales(t: Tables, *, k: int = 5) -> DataFrame:
    counted = count_by(t.cuentas, "sucursal", "sucursal", total="cuentas")
    return top_k(counted, k, F.desc("cuentas"), "sucursal")


def ctx_scores(t: Tables) -> DataFrame:
    return kpis.score_histogram(t, SCORE_LABELS_CORTAS)


# ── comparisons ─────────────────────────────────────────────────────────────────────────

def _headline_counts(t: Tables, operations: Years, products: Years) -> DataFrame:
    """Yearly counts of eight metrics, one scan per table."""
    every = F.lit(True)
    return stack([
        yearly_counts(t.cuentas, "fecha_apertura", products, {"cuentas_nuevas": every}),
        yearly_counts(
            t.transacciones, "fecha", operations,
            {"transacciones": every, "fraudes": F.col("es_fraude_potencial")},
        ),
        yearly_counts(t.prestamos, "fecha_otorgamiento", products, {"prestamos": every}),
        yearly_counts(t.pagos, "fecha_pago", operations, {"pagos": every}),
        yearly_counts(t.seguros, "fecha_inicio", products, {"seguros": every}),
        yearly_counts(
            t.metas_ahorro, "fecha_inicio", operations,
            {"metas_completadas": like_ci(F.col("estatus"), META_COMPLETADA)},
        ),
        yearly_counts(
            t.cobros, "fecha_cobro", operations, {"cobros_excedidos": F.col("excede_limite")}
        ),
    ])


def ctx_variacion_anual(
    t: Tables, *, operations: Years = ANIOS_OPERACIONES, products: Years = ANIOS_PRODUCTOS
) -> DataFrame:
    """Every metric in every year against the year listed before it."""
    return year_over_year(_headline_counts(t, operations, products))


def ctx_anio_maximo(
    t: Tables, *, operations: Years = ANIOS_OPERACIONES, products: Years = ANIOS_PRODUCTOS
) -> DataFrame:
    return best_year(_headline_counts(t, operations, products))


def ctx_comparativa_trimestral(t: Tables, *, now: int = 2024, before: int = 2023) -> DataFrame:
    """Transactions and frauds of the four quarters in two years."""
    compared = compare_two_years(
        t.transacciones, "fecha", now, before, "q", F.quarter("fecha"), 4,
        {"tx": F.lit(True), "fraudes": F.col("es_fraude_potencial")},
    )
    return compared.withColumn("trimestre", name_at(TRIMESTRES, F.col("q")))


def ctx_comparativa_trimestral_cuentas(
    t: Tables, *, now: int = 2023, before: int = 2022
) -> DataFrame:
    """Accounts opened in the four quarters of two years."""
    on = "fecha_apertura"
    compared = compare_two_years(
        t.cuentas, on, now, before, "q", F.quarter(on), 4, {"nuevas": F.lit(True)}
    )
    return compared.withColumn("trimestre", name_at(TRIMESTRES, F.col("q")))


def ctx_comparativa_mensual(t: Tables, *, now: int = 2024, before: int = 2023) -> DataFrame:
    """Transactions and frauds of the twelve months in two years."""
    compared = compare_two_years(
        t.transacciones, "fecha", now, before, "mes", F.month("fecha"), 12,
        {"tx": F.lit(True), "fraudes": F.col("es_fraude_potencial")},
    )
    return compared.withColumn("nombre_mes", name_at(MESES, F.col("mes")))


def ctx_indicadores(t: Tables) -> DataFrame:
    """The five risk percentages against their thresholds."""
    entries = [
        {
            "indicador": F.lit(label),
            "valor": F.col(column),
            "umbral": F.lit(threshold),
            "estado": F.when(F.col(column) > threshold, EN_RIESGO).otherwise(DENTRO_DEL_LIMITE),
        }
        for label, column, threshold in kpis.ETIQUETAS_RIESGO
    ]
    return unpivot_row(kpis.kpi_debilidades(t), entries)


# ── KPI frames under the context's column names (C20) ───────────────────────────────────

def ctx_utilizacion(t: Tables) -> DataFrame:
    return kpis.kpi_utilizacion_credito_resumen(t).withColumnsRenamed({
        "utilizacion_global": "util", "total_tarjetas": "tarjetas",
        "saldo_total": "saldo", "limite_total": "limite",
    })


def ctx_morosidad(t: Tables) -> DataFrame:
    return kpis.kpi_morosidad_tarjetas_resumen(t).withColumnsRenamed({
        "total_activas": "activas", "total_morosas": "morosas", "tasa_morosidad": "tasa",
    })


def ctx_pagos_por_estatus(t: Tables) -> DataFrame:
    return kpis.kpi_pagos_por_estatus(t).withColumnsRenamed({"estatus": "est", "porcentaje": "pct"})


def ctx_pagos_por_canal(t: Tables) -> DataFrame:
    return kpis.kpi_pagos_por_canal(t).withColumnsRenamed({"porcentaje": "pct"})


def ctx_seguros_por_estatus(t: Tables) -> DataFrame:
    return kpis.kpi_seguros_por_estatus(t).withColumnsRenamed({"estatus": "est", "porcentaje": "pct"})


def ctx_prima_anual(t: Tables) -> DataFrame:
    return kpis.kpi_prima_anual(t).withColumnsRenamed({
        "prima_promedio": "promedio", "prima_total": "total", "total_polizas": "polizas",
    })


def ctx_notificaciones_por_canal(t: Tables) -> DataFrame:
    return kpis.kpi_notificaciones_por_canal(t).withColumnsRenamed({"porcentaje": "pct"})


def ctx_metas_por_estatus(t: Tables) -> DataFrame:
    return kpis.kpi_metas_ahorro_por_estatus(t).withColumnsRenamed({"porcentaje": "pct"})


def ctx_metas_progreso(t: Tables) -> DataFrame:
    return kpis.kpi_metas_ahorro_progreso(t).withColumnsRenamed({
        "progreso_promedio": "progreso", "total_activas": "activas",
        "monto_objetivo_total": "objetivo", "monto_actual_total": "actual",
    })


def ctx_nomina(t: Tables) -> DataFrame:
    return kpis.kpi_nomina_resumen(t).select(
        F.col("total_empresas").alias("total"), "con_nomina",
        F.col("porcentaje_penetracion").alias("pct"),
    )


def ctx_segmentos(t: Tables) -> DataFrame:
    return kpis.kpi_clientes_por_segmento(t).withColumnsRenamed({"segmento": "seg"})
