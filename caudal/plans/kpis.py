"""The KPI catalogue (K01-K31): each takes the banking tables and returns one lazy frame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from caudal.functions.dates import instant, month_label, whole_days
from caudal.functions.numbers import (
    as_double, count_true, mean_of, money_sum, pct_of_counts, pct_of_sums,
)
from caudal.functions.text import plain_number
from caudal.operators.grouping import count_by, one_row, share_by, unpivot_row
from caudal.operators.ranking import top_k
from caudal.plans.daily import volume_since
from caudal.sources.tables import Tables

Day = str | dt.date

# Status words, bucket edges, thresholds and texts the results must carry.
CUENTA_ACTIVA = "Activa"
CUENTA_CANCELADA = "Cancelada"
PRESTAMO_VIGENTE = "Vigente"
PRESTAMO_VENCIDO = "Vencido"
PRESTAMO_LIQUIDADO = "Liquidado"
PRESTAMOS_CON_TASA = ("Al corriente", "Vencido", "En reestructura")
TARJETA_ACTIVA = "Activa"
TARJETA_BLOQUEADA = "Bloqueada"
SEGURO_ACTIVO = "Activo"
META_FALLIDA = "Fallida"
METAS_EN_CURSO = ("Activa", "En progreso")
AUDITORIA_EXCEDE = "Excede"
SCORE_EDGES = (500, 650, 750)
SCORE_LABELS = ("Malo (< 500)", "Regular (500-649)", "Bueno (650-749)", "Excelente (750+)")
INDICADORES = (
    # column, threshold in percent, area, problem after the number, solution, priority
    ("porcentajeFraudePotencial", 5, "Seguridad", "% de transacciones con riesgo de fraude",
     "Implementar autenticación de dos factores y revisar reglas del motor antifraude", "Alta"),
    ("porcentajeCobrosExcedidos", 10, "Cumplimiento", "% de cobros exceden el límite legal",
     "Auditar el catálogo de comisiones y alinear tarifas con la circular CNBV vigente", "Alta"),
    ("porcentajeCuentasCanceladas", 20, "Retención", "% de cuentas canceladas",
     "Lanzar programa de reactivación con beneficios diferenciados por segmento", "Media"),
    ("porcentajePrestamosVencidos", 15, "Cartera", "% de préstamos vencidos",
     "Reforzar proceso de cobranza preventiva y ofrecer reestructuración anticipada", "Alta"),
    ("porcentajeMetasFallidas", 30, "Ahorro", "% de metas de ahorro fallidas",
     "Enviar recordatorios automáticos y ofrecer microcréditos puente para completar metas", "Baja"),
)
_ETIQUETAS = (
    "Fraude potencial", "Cobros excedidos", "Cuentas canceladas", "Préstamos vencidos",
    "Metas de ahorro fallidas",
)
# label, column, threshold in percent
ETIQUETAS_RIESGO = tuple(
    (label, column, threshold)
    for label, (column, threshold, *_) in zip(_ETIQUETAS, INDICADORES, strict=True)
)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _sum_where(keep: Column, value: str) -> Column:
    return as_double(_or_zero(F.sum(F.when(keep, F.col(value)))))


# ── headline numbers ────────────────────────────────────────────────────────────────────

def account_totals(status: str = CUENTA_ACTIVA) -> list[Column]:
    active = F.col("estatus") == status
    return [
        count_true(active).alias("cuentasActivas"),
        _sum_where(active, "saldo").alias("saldoTotalCuentas"),
    ]


def loan_totals(status: str = PRESTAMO_VIGENTE) -> list[Column]:
    current = F.col("estatus_prestamo") == status
    return [
        count_true(current).alias("prestamosActivos"),
        _sum_where(current, "saldo_prestamo").alias("montoPrestamosVigentes"),
    ]


def over_limit_fees() -> Column:
    return count_true(F.col("excede_limite")).alias("cobrosExcedidos")


def transactions_per_day(t: Tables) -> DataFrame:
    """(dia, n, fraudes): all that the headline numbers need of the transactions."""
    return t.transacciones.groupBy(F.to_date("fecha").alias("dia")).agg(
        F.count("*").alias("n"), count_true(F.col("es_fraude_potencial")).alias("fraudes")
    )


def day_totals() -> list[Column]:
    return [
        _or_zero(F.max_by("n", "dia")).alias("transaccionesHoy"),
        _or_zero(F.sum("fraudes")).alias("fraudesPotenciales"),
    ]


def kpi_resumen(t: Tables) -> DataFrame:
    """Eight headline counts and balances; one scan per table.

    "Today" is the calendar day of the latest transaction. Transactions are first counted
    per day, so the latest day falls out of a handful of daily rows, not a second scan.
    """
    return one_row(
        t.clientes.agg(F.count("*").alias("totalClientes")),
        t.cuentas.agg(*account_totals()),
        t.prestamos.agg(*loan_totals()),
        transactions_per_day(t).agg(*day_totals()),
        t.cobros.agg(over_limit_fees()),
    )


# ── clients ─────────────────────────────────────────────────────────────────────────────

def kpi_clientes_por_segmento(t: Tables) -> DataFrame:
    counted = count_by(t.open_data, "segmento_cliente", "segmento")
    return counted.orderBy(F.desc("total"), "segmento")


def kpi_clientes_por_genero(t: Tables) -> DataFrame:
    return count_by(t.clientes, "genero", "genero").orderBy(F.desc("total"), "genero")


# ── transactions ────────────────────────────────────────────────────────────────────────

def _volume(df: DataFrame, key: Column, name: str, daily: bool) -> DataFrame:
    """Rows and amount per key of transactions, or of their daily aggregate."""
    total = F.sum("n") if daily else F.count("*")
    return df.groupBy(key.alias(name)).agg(
        total.alias("total"), money_sum(F.col("monto")).alias("monto_total")
    )


def _volume_by(tx: DataFrame, key: str, diario: DataFrame | None = None) -> DataFrame:
    df = tx if diario is None else diario
    return _volume(df.filter(F.col(key).isNotNull()), F.col(key), key, diario is not None)


def kpi_transacciones_por_categoria(t: Tables, *, diario: DataFrame | None = None) -> DataFrame:
    """Volume by category; from the stored daily aggregate if one is given."""
    volume = _volume_by(t.transacciones, "categoria", diario)
    return volume.orderBy(F.desc_nulls_first("monto_total"), "categoria")


def kpi_transacciones_por_canal(t: Tables, *, diario: DataFrame | None = None) -> DataFrame:
    """Volume by channel; from the stored daily aggregate if one is given."""
    return _volume_by(t.transacciones, "canal", diario).orderBy(F.desc("total"), "canal")


def trend_start(tx: DataFrame, as_of: str | dt.datetime | None) -> Column:
    """Twelve months before ``as_of``, or before the latest transaction."""
    year = F.make_ym_interval(months=F.lit(12))
    if as_of is not None:
        return instant(as_of) - year
    return tx.agg(F.max("fecha") - year).scalar()


def trend_cut(diario: DataFrame, as_of: str | dt.datetime | None) -> DataFrame:
    """:func:`trend_start` as one row with ``corte``, from a daily aggregate."""
    year = F.make_ym_interval(months=F.lit(12))
    if as_of is not None:
        return diario.sparkSession.range(1).select((instant(as_of) - year).alias("corte"))
    return diario.agg((F.max("ultima") - year).alias("corte"))


def kpi_tendencia(
    t: Tables, *, as_of: str | dt.datetime | None = None, diario: DataFrame | None = None
) -> DataFrame:
    """Monthly volume of the 12 months before ``as_of`` (default: the latest transaction).

    The first month is partial, as the cut is at the instant and not at the month's start.
    The default cut is computed inside the subquery, so the scan gets it as a plain bound. With a
    stored daily aggregate only the rest of the cut's own day is read from the transactions.
    """
    tx = t.transacciones
    if diario is None:
        recent, on = tx.filter(F.col("fecha") >= trend_start(tx, as_of)), "fecha"
    else:
        recent, on = volume_since(tx, diario, trend_cut(diario, as_of)), "dia"
    return _volume(recent, month_label(F.col(on)), "mes", diario is not None).orderBy("mes")


# ── loans, accounts, scores, fees ───────────────────────────────────────────────────────

def kpi_prestamos_por_tipo(t: Tables) -> DataFrame:
    return (
        t.prestamos.filter(F.col("tipo_prestamo").isNotNull())
        .groupBy(F.col("tipo_prestamo").alias("tipo"))
        .agg(F.count("*").alias("total"), money_sum(F.col("saldo_prestamo")).alias("saldo_total"))
        .orderBy(F.desc_nulls_first("saldo_total"), "tipo")
    )


def kpi_saldo_por_tipo_cuenta(t: Tables, *, status: str = CUENTA_ACTIVA) -> DataFrame:
    return (
        t.cuentas.filter((F.col("estatus") == status) & F.col("tipo_cuenta").isNotNull())
        .groupBy(F.col("tipo_cuenta").alias("tipo"))
        .agg(F.count("*").alias("total_cuentas"), money_sum(F.col("saldo")).alias("saldo_total"))
        .orderBy(F.desc_nulls_first("saldo_total"), "tipo")
    )


def score_range(score: Column, labels: tuple[str, ...] = SCORE_LABELS) -> Column:
    low, mid, high = SCORE_EDGES
    return (
        F.when(score < low, labels[0])
        .when(score < mid, labels[1])
        .when(score < high, labels[2])
        .otherwise(labels[3])
    )


def score_histogram(t: Tables, labels: tuple[str, ...]) -> DataFrame:
    score = F.col("score_crediticio")
    return (
        t.open_data.filter(score.isNotNull())
        .groupBy(score_range(score, labels).alias("rango"))
        .agg(F.count("*").alias("total"), F.min(score).alias("_desde"))
        .orderBy("_desde")
        .drop("_desde")
    )


def kpi_score_crediticio(t: Tables) -> DataFrame:
    return score_histogram(t, SCORE_LABELS)


def kpi_cobros_excedidos(t: Tables, *, result: str = AUDITORIA_EXCEDE) -> DataFrame:
    """Audited fees over the limit by type; fees without a type stay as a NULL group."""
    return (
        t.auditoria_comisiones.filter(F.col("resultado") == result)
        .groupBy(F.col("tipo_comision").alias("tipo"))
        .agg(F.count("*").alias("total"), money_sum(F.col("diferencia")).alias("diferencia_total"))
        .orderBy(F.desc_nulls_first("diferencia_total"), "tipo")
    )


# ── weak points and recommendations ─────────────────────────────────────────────────────

def _risk(part: Column, whole: Column, name: str) -> Column:
    return _or_zero(pct_of_counts(part, whole)).alias(name)


def over_limit_risk() -> Column:
    over = count_true(F.col("excede_limite"))
    return _risk(over, F.count("*"), "porcentajeCobrosExcedidos")


def canceled_risk() -> Column:
    canceled = count_true(F.col("estatus") == CUENTA_CANCELADA)
    return _risk(canceled, F.count("*"), "porcentajeCuentasCanceladas")


def overdue_risk() -> Column:
    overdue = count_true(F.col("estatus_prestamo") == PRESTAMO_VENCIDO)
    open_loans = count_true(F.col("estatus_prestamo") != PRESTAMO_LIQUIDADO)
    return _risk(overdue, open_loans, "porcentajePrestamosVencidos")


def failed_goal_risk() -> Column:
    failed = count_true(F.col("estatus") == META_FALLIDA)
    return _risk(failed, F.count("*"), "porcentajeMetasFallidas")


def kpi_debilidades(t: Tables) -> DataFrame:
    """Five risk percentages; a table without rows reads as 0."""
    fraud = count_true(F.col("es_fraude_potencial"))
    return one_row(
        t.transacciones.agg(_risk(fraud, F.count("*"), "porcentajeFraudePotencial")),
        t.cobros.agg(over_limit_risk()),
        t.cuentas.agg(canceled_risk()),
        t.prestamos.agg(overdue_risk()),
        t.metas_ahorro.agg(failed_goal_risk()),
    )


def fraud_rate(frauds: Column, total: Column) -> Column:
    return _risk(frauds, total, "porcentajeFraudePotencial")


def resumen_y_debilidades(t: Tables, transactions: DataFrame | None = None) -> DataFrame:
    """The columns of :func:`kpi_resumen` and :func:`kpi_debilidades` from one scan per table.

    ``transactions`` is a row with what both need of the transactions, if there is one.
    """
    if transactions is None:
        rate = fraud_rate(F.sum("fraudes"), F.sum("n"))
        transactions = transactions_per_day(t).agg(*day_totals(), rate)
    return one_row(
        t.clientes.agg(F.count("*").alias("totalClientes")),
        t.cuentas.agg(*account_totals(), canceled_risk()),
        t.prestamos.agg(*loan_totals(), overdue_risk()),
        transactions,
        t.cobros.agg(over_limit_fees(), over_limit_risk()),
        t.metas_ahorro.agg(failed_goal_risk()),
    )


def kpi_soluciones(t: Tables) -> DataFrame:
    """A recommendation for each indicator strictly above its threshold."""
    entries = [
        {
            "area": F.lit(area),
            "problema": F.concat(plain_number(F.col(column)), F.lit(problem)),
            "solucion": F.lit(solution),
            "prioridad": F.lit(priority),
            "_sobre": F.col(column) > threshold,
        }
        for column, threshold, area, problem, solution, priority in INDICADORES
    ]
    return unpivot_row(kpi_debilidades(t), entries).filter("_sobre").drop("_sobre")


# ── payments, insurance, notifications, branches, payroll ───────────────────────────────

def kpi_pagos_por_estatus(t: Tables) -> DataFrame:
    return share_by(t.pagos, "estatus_pago", "estatus")


def kpi_pagos_por_canal(t: Tables) -> DataFrame:
    return share_by(t.pagos, "canal_pago", "canal")


def kpi_seguros_por_estatus(t: Tables) -> DataFrame:
    return share_by(t.seguros, "estatus_seguro", "estatus")


def kpi_prima_anual(t: Tables, *, status: str = SEGURO_ACTIVO) -> DataFrame:
    premium = F.col("prima_anual")
    return t.seguros.filter((F.col("estatus_seguro") == status) & premium.isNotNull()).agg(
        mean_of(premium).alias("prima_promedio"),
        money_sum(premium).alias("prima_total"),
        F.count("*").alias("total_polizas"),
    )


def kpi_notificaciones_por_estatus(t: Tables) -> DataFrame:
    return share_by(t.notificaciones, "estatus_notificacion", "estatus")


def kpi_notificaciones_por_canal(t: Tables) -> DataFrame:
    return share_by(t.notificaciones, "canal_notificacion", "canal")


def kpi_cuentas_por_sucursal(t: Tables, *, k: int = 20, since: Day | None = None) -> DataFrame:
    """The ``k`` branches with most accounts; ``since`` optionally keeps newer ones only."""
    cuentas = t.cuentas
    if since is not None:
        cuentas = cuentas.filter(whole_days(F.col("fecha_apertura"), since, None))
    counted = count_by(cuentas, "sucursal", "sucursal", total="nuevas_cuentas")
    return top_k(counted, k, F.desc("nuevas_cuentas"), "sucursal")


def kpi_nomina_resumen(t: Tables) -> DataFrame:
    pays = F.col("paga_nomina")
    return t.datos_negocio.agg(
        F.count("*").alias("total_empresas"),
        count_true(pays).alias("con_nomina"),
        count_true(~pays | pays.isNull()).alias("sin_nomina"),
        pct_of_counts(count_true(pays), F.count("*")).alias("porcentaje_penetracion"),
    )


# ── cards ───────────────────────────────────────────────────────────────────────────────

def _cards_in_use(t: Tables) -> DataFrame:
    return t.tarjetas.filter(
        (F.col("estatus_tarjeta") == TARJETA_ACTIVA) & (F.col("limite_credito") > 0)
    )


def kpi_utilizacion_credito(t: Tables) -> DataFrame:
    """Mean of each card's balance / limit, by card type (not the ratio of the totals)."""
    use = as_double(F.col("saldo_tarjeta")) / as_double(F.col("limite_credito"))
    return (
        _cards_in_use(t)
        .filter(F.col("tipo_tarjeta").isNotNull())
        .groupBy("tipo_tarjeta")
        .agg(
            F.count("*").alias("total_tarjetas"),
            F.round(100 * F.avg(use), 2).alias("utilizacion_promedio"),
            money_sum(F.col("saldo_tarjeta")).alias("saldo_total"),
            money_sum(F.col("limite_credito")).alias("limite_total"),
        )
        .orderBy(F.desc_nulls_first("utilizacion_promedio"), "tipo_tarjeta")
    )


def kpi_utilizacion_credito_resumen(t: Tables) -> DataFrame:
    """Total balance / total limit of the cards in use."""
    balance, limit = F.sum("saldo_tarjeta"), F.sum("limite_credito")
    return _cards_in_use(t).agg(
        pct_of_sums(balance, limit).alias("utilizacion_global"),
        F.count("*").alias("total_tarjetas"),
        as_double(balance).alias("saldo_total"),
        as_double(limit).alias("limite_total"),
    )


def kpi_morosidad_tarjetas(t: Tables) -> DataFrame:
    """Blocked cards among active and blocked ones, by card type."""
    blocked = count_true(F.col("estatus_tarjeta") == TARJETA_BLOQUEADA)
    return (
        t.tarjetas.filter(
            F.col("tipo_tarjeta").isNotNull()
            & F.col("estatus_tarjeta").isin(TARJETA_ACTIVA, TARJETA_BLOQUEADA)
        )
        .groupBy("tipo_tarjeta")
        .agg(
            F.count("*").alias("total"),
            blocked.alias("morosas"),
            count_true(F.col("estatus_tarjeta") == TARJETA_ACTIVA).alias("al_corriente"),
            pct_of_counts(blocked, F.count("*")).alias("tasa_morosidad"),
        )
        .orderBy(F.desc("tasa_morosidad"), "tipo_tarjeta")
    )


def kpi_morosidad_tarjetas_resumen(t: Tables) -> DataFrame:
    blocked = count_true(F.col("estatus_tarjeta") == TARJETA_BLOQUEADA)
    either = count_true(F.col("estatus_tarjeta").isin(TARJETA_ACTIVA, TARJETA_BLOQUEADA))
    return t.tarjetas.agg(
        either.alias("total_activas"),
        blocked.alias("total_morosas"),
        pct_of_counts(blocked, either).alias("tasa_morosidad"),
    )


# ── loan pricing and savings goals ──────────────────────────────────────────────────────

def kpi_tasa_interes_prestamos(
    t: Tables, *, statuses: tuple[str, ...] = PRESTAMOS_CON_TASA
) -> DataFrame:
    rate = F.col("tasa_prestamo")
    return (
        t.prestamos.filter(
            F.col("estatus_prestamo").isin(*statuses)
            & F.col("tipo_prestamo").isNotNull()
            & rate.isNotNull()
        )
        .groupBy("tipo_prestamo")
        .agg(
            F.count("*").alias("total"),
            mean_of(rate).alias("tasa_promedio"),
            as_double(F.min(rate)).alias("tasa_minima"),
            as_double(F.max(rate)).alias("tasa_maxima"),
            money_sum(F.col("monto_prestamo")).alias("monto_total"),
        )
        .orderBy(F.desc("tasa_promedio"), "tipo_prestamo")
    )


def kpi_metas_ahorro_por_estatus(t: Tables) -> DataFrame:
    return share_by(t.metas_ahorro, "estatus", "estatus")


def kpi_metas_ahorro_progreso(
    t: Tables, *, statuses: tuple[str, ...] = METAS_EN_CURSO
) -> DataFrame:
    progress = as_double(F.col("monto_actual")) / as_double(F.col("monto_objetivo"))
    return t.metas_ahorro.filter(
        F.col("estatus").isin(*statuses) & (F.col("monto_objetivo") > 0)
    ).agg(
        F.round(100 * F.avg(progress), 2).alias("progreso_promedio"),
        F.count("*").alias("total_activas"),
        money_sum(F.col("monto_objetivo")).alias("monto_objetivo_total"),
        money_sum(F.col("monto_actual")).alias("monto_actual_total"),
    )


# ── period KPIs ─────────────────────────────────────────────────────────────────────────

def kpi_resumen_periodo(t: Tables, *, desde: Day, hasta: Day) -> DataFrame:
    """Nine numbers for [desde, hasta]; accounts and clients are cumulative up to ``hasta``.

    Accounts are folded to one row per client first. That row says both what the client's
    accounts add up to and that the client has one, so a single scan serves the account
    totals and the count of clients, and a client with very many accounts is combined
    before the shuffle.
    """
    active = F.col("estatus") == CUENTA_ACTIVA
    per_client = (
        t.cuentas.filter(whole_days(F.col("fecha_apertura"), None, hasta))
        .groupBy("id_cliente")
        .agg(
            count_true(active).alias("activas"),
            F.sum(F.when(active, F.col("saldo"))).alias("saldo"),
        )
    )
    known = t.clientes.select("id_cliente", F.lit(1).alias("existe"))
    accounts = per_client.join(known, "id_cliente", "left").agg(
        F.count("existe").alias("totalClientes"),
        _or_zero(F.sum("activas")).alias("cuentasActivas"),
        as_double(_or_zero(F.sum("saldo"))).alias("saldoTotalCuentas"),
    )
    tx = t.transacciones.filter(whole_days(F.col("fecha"), desde, hasta)).agg(
        F.count("*").alias("transacciones"),
        as_double(_or_zero(F.sum("monto"))).alias("montoTransacciones"),
        count_true(F.col("es_fraude_potencial")).alias("fraudesPotenciales"),
    )
    fees = t.cobros.filter(whole_days(F.col("fecha_cobro"), desde, hasta)).agg(
        count_true(F.col("excede_limite")).alias("cobrosExcedidos")
    )
    loans = t.prestamos.filter(
        (F.col("estatus_prestamo") == PRESTAMO_VIGENTE)
        & whole_days(F.col("fecha_otorgamiento"), desde, hasta)
    ).agg(
        F.count("*").alias("prestamosActivos"),
        as_double(_or_zero(F.sum("saldo_prestamo"))).alias("montoPrestamos"),
    )
    return one_row(accounts, tx, fees, loans)


def kpi_clientes_nuevos(t: Tables, *, desde: Day, hasta: Day) -> DataFrame:
    """Distinct clients with any account opened in the period."""
    opened = t.cuentas.filter(whole_days(F.col("fecha_apertura"), desde, hasta))
    return opened.agg(F.count_distinct("id_cliente").alias("nuevos"))


def kpi_prestamos_periodo(t: Tables, *, desde: Day, hasta: Day) -> DataFrame:
    """Loans granted in the period by type; loans without a type stay as a NULL group."""
    return (
        t.prestamos.filter(whole_days(F.col("fecha_otorgamiento"), desde, hasta))
        .groupBy(F.col("tipo_prestamo").alias("tipoPrestamo"))
        .agg(F.count("*").alias("total"), money_sum(F.col("saldo_prestamo")).alias("saldo_total"))
    )


def kpi_canal_periodo(
    t: Tables, *, desde: Day, hasta: Day, diario: DataFrame | None = None
) -> DataFrame:
    """Volume by channel within a period; from the stored daily aggregate if one is given."""
    inside = t.transacciones.filter(whole_days(F.col("fecha"), desde, hasta))
    if diario is not None:
        diario = diario.filter(whole_days(F.col("dia"), desde, hasta))
    return _volume_by(inside, "canal", diario).orderBy(F.desc("total"), "canal")
