"""Every query by name, bound to the sample tables of one folder."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from caudal.plans import daily, fraud, fraud_mart, history, kpis, lookups, report
from caudal.schemas import MART_DDL
from caudal.session import scratch_path, shared_dir
from caudal.sources.layouts import lay_out_by_client, stored_page_info
from caudal.sources.mart import open_mart, source_version
from caudal.sources.sample_bank import sample_bank
from caudal.sources.tables import Tables, read_exchange_rates
from caudal.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the sample runs.
DESDE, HASTA = "1996-02-10", "1998-07-15"
YEARS = [1996, 1997, 1998]
NOW, BEFORE = 1998, 1997


def _dated(plan: Callable[..., DataFrame], **params) -> Query:
    """A plan over seven years of dated transactions."""
    return lambda spark, sf_dir: plan(sample_bank(spark, sf_dir), **params)


def _timed(plan: Callable[..., DataFrame], **params) -> Query:
    """A plan over transactions with times of day."""
    return lambda spark, sf_dir: plan(sample_bank(spark, sf_dir, timed=True), **params)


def _mart_folder(spark: SparkSession, sf_dir: str) -> str:
    """One mart for each sample folder, for all sessions that share the scratch folder."""
    name = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return os.path.join(shared_dir(spark), "caudal", f"mart-{name}")


def _mart(spark: SparkSession, sf_dir: str) -> Tables:
    """The mart of a sample folder; loaded by the first query that asks, in whatever session,
    and anew when the folder has changed."""
    t = sample_bank(spark, sf_dir, timed=True)
    return fraud.loaded_mart(
        spark, t, _mart_folder(spark, sf_dir), source=source_version(spark, sf_dir)
    )


def _in_another_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each mart table as a session sees them that has neither loaded nor views."""
    _mart(spark, sf_dir)
    mart = open_mart(spark.newSession(), _mart_folder(spark, sf_dir))
    counts = [
        mart[name].agg(F.count("*").alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        for name in MART_DDL
    ]
    return functools.reduce(DataFrame.unionByName, counts)


def _from_mart(serve: Callable[..., DataFrame], **params) -> Query:
    """A serving query over the loaded mart."""
    return lambda spark, sf_dir: serve(_mart(spark, sf_dir), **params)


def _of_alerts(plan: Callable[[DataFrame], DataFrame]) -> Query:
    """A breakdown of the alerts that the mart holds."""
    return lambda spark, sf_dir: plan(_mart(spark, sf_dir).alertas_fraude)


def _fraud_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = sample_bank(spark, sf_dir, timed=True).transacciones
    alerts = _mart(spark, sf_dir).alertas_fraude
    return fraud.fraud_summary(alerts, tx.agg(F.count("*").alias("n")))


def _flag(rule: Callable[..., DataFrame], flag: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule(sample_bank(spark, sf_dir, timed=True)).select("id_transaccion", flag)

    return run


def _etl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the whole load, then reads the published views back."""
    t = sample_bank(spark, sf_dir, timed=True)
    fraud.etl_run(spark, t, scratch_path(spark, "mart"))
    return fraud_mart.etl_resumen(fraud_mart.mart_views(spark))


def _some_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as a DataFrame: the clients with an overdue loan, and an id of nobody."""
    overdue = sample_bank(spark, sf_dir).prestamos.filter(F.col("estatus_prestamo") == "Vencido")
    nobody = spark.range(1).select(F.lit("nadie").alias("id_cliente"))
    return overdue.select("id_cliente").unionByName(nobody)


def _of_some_clients(plan: Callable[..., DataFrame], timed: bool = False, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = sample_bank(spark, sf_dir, timed=timed)
        return plan(t, _some_clients(spark, sf_dir), **params)

    return run


def _csv_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates written as dd/mm/yyyy text and read back through the CSV source."""
    path = scratch_path(spark, "tipo_cambio")
    rates = sample_bank(spark, sf_dir).tipo_cambio
    (
        rates.select(F.date_format("fecha", "dd/MM/yyyy").alias("Fecha"), F.col("rate").alias("Dato"))
        .write.option("header", True)
        .csv(path)
    )
    return read_exchange_rates(spark, path)


def _from_days(plan: Callable[..., DataFrame], **params) -> Query:
    """A plan over the stored daily aggregate, which the first query that asks makes."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = sample_bank(spark, sf_dir)
        state = f"{sf_dir.rstrip('/')} {source_version(spark, sf_dir)}"
        name = hashlib.sha256(state.encode()).hexdigest()[:16]
        folder = os.path.join(shared_dir(spark), "caudal", f"diario-{name}")
        if daily.loads(spark, folder).isEmpty():
            daily.refresh_daily(spark, t.transacciones, folder)
        return plan(t, diario=daily.stored_daily(spark, folder), **params)

    return run


def _stored_list(
    store: Callable[..., None], read: Callable[..., DataFrame], *, page: int, limit: int
) -> Query:
    """A page of a list that is stored first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, folder = sample_bank(spark, sf_dir), scratch_path(spark, "paginas")
        store(t, folder)
        return read(spark, t, folder, page=page, limit=limit)

    return run


def _of_laid_out(plan: Callable[..., DataFrame], *names: str, **params) -> Query:
    """A lookup over tables that are clustered by client first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = scratch_path(spark, "por-cliente")
        lay_out_by_client(sample_bank(spark, sf_dir), folder, names=names)
        return plan(Tables.from_parquet(spark, folder), **params)

    return run


def _streamed(job: Callable[..., DataFrame], **params) -> Query:
    return lambda spark, sf_dir: job(spark, sf_dir, **params)


_PERIOD = {"desde": DESDE, "hasta": HASTA}
_HISTORY = {"operations": YEARS, "products": YEARS}
_PAGE = {"page": 2, "limit": 25}
_AFTER_ALERT = {"fecha": "2024-01-20 00:00:00", "id_transaccion": "E5", "limit": 25}

KPI_QUERIES: dict[str, Query] = {
    "kpi_resumen": _dated(kpis.kpi_resumen),
    "kpi_clientes_por_segmento": _dated(kpis.kpi_clientes_por_segmento),
    "kpi_clientes_por_genero": _dated(kpis.kpi_clientes_por_genero),
    "kpi_transacciones_por_categoria": _dated(kpis.kpi_transacciones_por_categoria),
    "kpi_transacciones_por_canal": _dated(kpis.kpi_transacciones_por_canal),
    "kpi_tendencia": _dated(kpis.kpi_tendencia),
    "kpi_prestamos_por_tipo": _dated(kpis.kpi_prestamos_por_tipo),
    "kpi_saldo_por_tipo_cuenta": _dated(kpis.kpi_saldo_por_tipo_cuenta),
    "kpi_score_crediticio": _dated(kpis.kpi_score_crediticio),
    "kpi_cobros_excedidos": _dated(kpis.kpi_cobros_excedidos),
    "kpi_debilidades": _dated(kpis.kpi_debilidades),
    "kpi_soluciones": _dated(kpis.kpi_soluciones),
    "kpi_pagos_por_estatus": _dated(kpis.kpi_pagos_por_estatus),
    "kpi_pagos_por_canal": _dated(kpis.kpi_pagos_por_canal),
    "kpi_seguros_por_estatus": _dated(kpis.kpi_seguros_por_estatus),
    "kpi_prima_anual": _dated(kpis.kpi_prima_anual),
    "kpi_notificaciones_por_estatus": _dated(kpis.kpi_notificaciones_por_estatus),
    "kpi_notificaciones_por_canal": _dated(kpis.kpi_notificaciones_por_canal),
    "kpi_cuentas_por_sucursal": _dated(kpis.kpi_cuentas_por_sucursal),
    "kpi_nomina_resumen": _dated(kpis.kpi_nomina_resumen),
    "kpi_utilizacion_credito": _dated(kpis.kpi_utilizacion_credito),
    "kpi_utilizacion_credito_resumen": _dated(kpis.kpi_utilizacion_credito_resumen),
    "kpi_morosidad_tarjetas": _dated(kpis.kpi_morosidad_tarjetas),
    "kpi_morosidad_tarjetas_resumen": _dated(kpis.kpi_morosidad_tarjetas_resumen),
    "kpi_tasa_interes_prestamos": _dated(kpis.kpi_tasa_interes_prestamos),
    "kpi_metas_ahorro_por_estatus": _dated(kpis.kpi_metas_ahorro_por_estatus),
    "kpi_metas_ahorro_progreso": _dated(kpis.kpi_metas_ahorro_progreso),
    "kpi_resumen_periodo": _dated(kpis.kpi_resumen_periodo, **_PERIOD),
    "kpi_clientes_nuevos": _dated(kpis.kpi_clientes_nuevos, **_PERIOD),
    "kpi_prestamos_periodo": _dated(kpis.kpi_prestamos_periodo, **_PERIOD),
    "kpi_canal_periodo": _dated(kpis.kpi_canal_periodo, **_PERIOD),
}

FRAUD_QUERIES: dict[str, Query] = {
    "fraud_r1_geo": _flag(fraud.fraud_r1_geo, "r1_geo"),
    "fraud_r2_velocity": _flag(fraud.fraud_r2_velocity, "r2_velocidad"),
    "fraud_r3_amount": _flag(fraud.fraud_r3_amount, "r3_monto"),
    "fraud_r4_hour": _flag(fraud.fraud_r4_hour, "r4_hora"),
    "fraud_alerts": _timed(fraud.fraud_alerts),
    "fraud_by_category": _of_alerts(fraud.fraud_by_category),
    "fraud_by_channel": _of_alerts(fraud.fraud_by_channel),
    "fraud_by_month": _of_alerts(fraud.fraud_by_month),
    "fraud_summary": _fraud_summary,
    "etl_run": _etl,
    "etl_tipo_cambio_csv": _csv_rates,
    "etl_resumen": _from_mart(fraud_mart.etl_resumen),
    "etl_otra_sesion": _in_another_session,
    "etl_fraude_por_categoria": _from_mart(fraud_mart.etl_fraude_por_categoria),
    "etl_fraude_por_canal": _from_mart(fraud_mart.etl_fraude_por_canal),
    "etl_fraude_por_mes": _from_mart(fraud_mart.etl_fraude_por_mes),
    "etl_fraude_geografico": _dated(fraud_mart.etl_fraude_geografico),
    "etl_fraude_por_comercio": _dated(fraud_mart.etl_fraude_por_comercio),
    "etl_alertas_fraude": _from_mart(fraud_mart.etl_alertas_fraude, **_PAGE),
    "etl_alertas_fraude_info": _from_mart(fraud_mart.etl_alertas_fraude_info, **_PAGE),
    "etl_alertas_fraude_after": _from_mart(fraud_mart.etl_alertas_fraude_after, **_AFTER_ALERT),
    "etl_resumen_periodo": _dated(fraud_mart.etl_resumen_periodo, **_PERIOD),
}

_CLIENT_FILTERS = {"nombre": "ez", "segmento": "BUILDING", "riesgo": "Medio"}
_TX_FILTERS = {
    "desde": "1996-02-10", "hasta": "1999-12-31", "canal": "Web", "fraude": True,
    "tipo": "Retiro",
}

LOOKUP_QUERIES: dict[str, Query] = {
    "clientes_list": _dated(lookups.clientes_list, page=2, limit=5, **_CLIENT_FILTERS),
    "clientes_list_info": _dated(lookups.clientes_list_info, page=2, limit=5, **_CLIENT_FILTERS),
    "cliente_perfil": lambda spark, sf_dir: flat_profile(
        lookups.cliente_perfil(sample_bank(spark, sf_dir))
    ),
    "cliente_cuentas": _dated(lookups.cliente_cuentas),
    "cliente_transacciones": _timed(lookups.cliente_transacciones, limit=50),
    "cliente_prestamos": _dated(lookups.cliente_prestamos),
    "cliente_tarjetas": _dated(lookups.cliente_tarjetas),
    "cliente_metas": _dated(lookups.cliente_metas),
    "transacciones_list": _dated(lookups.transacciones_list, page=2, limit=50, **_TX_FILTERS),
    "transacciones_list_info": _dated(
        lookups.transacciones_list_info, page=2, limit=50, **_TX_FILTERS
    ),
    "transaccion_detalle": _timed(lookups.transaccion_detalle),
    "clientes_list_after": _dated(
        lookups.clientes_list_after, apellido_paterno="Martínez", id_cliente="C4", limit=5,
        **_CLIENT_FILTERS,
    ),
    "transacciones_list_after": _dated(
        lookups.transacciones_list_after, fecha=dt.datetime(1998, 3, 1), id_transaccion="L2",
        limit=50, **_TX_FILTERS,
    ),
    "cliente_perfil_por_id": lambda spark, sf_dir: flat_profile(
        lookups.cliente_perfil(sample_bank(spark, sf_dir), "C12")
    ),
    "cliente_cuentas_por_id": _dated(lookups.cliente_cuentas, ids=["C7", "C12", "nadie"]),
    "transaccion_detalle_por_id": _timed(lookups.transaccion_detalle, ids=["E3", "E86", "X"]),
    "cliente_cuentas_de_varios": _of_some_clients(lookups.cliente_cuentas),
    "clientes_list_guardada": _stored_list(
        lookups.store_clientes, lookups.clientes_stored_page, page=4, limit=20
    ),
    "transacciones_list_guardada": _stored_list(
        lookups.store_transacciones, lookups.transacciones_stored_page, page=37, limit=50
    ),
    "transacciones_list_guardada_info": _stored_list(
        lookups.store_transacciones,
        lambda spark, t, folder, **page: stored_page_info(spark, folder, **page), page=37, limit=50,
    ),
    "cliente_transacciones_por_id": _of_laid_out(
        lookups.cliente_transacciones, "transacciones", "clientes", ids=["C7", "C12", "nadie"], limit=20
    ),
    "cliente_transacciones_de_varios": _of_some_clients(
        lookups.cliente_transacciones, timed=True, limit=20
    ),
}

HISTORY_QUERIES: dict[str, Query] = {
    "ctx_snapshot": _dated(history.ctx_snapshot),
    "ctx_tx_anual": _dated(history.ctx_tx_anual, years=YEARS),
    "ctx_tx_anual_texto": _dated(history.ctx_tx_anual_texto, years=YEARS),
    "ctx_cuentas_anual": _dated(history.ctx_cuentas_anual, years=YEARS),
    "ctx_pagos_anual": _dated(history.ctx_pagos_anual, years=YEARS),
    "ctx_prestamos_anual": _dated(history.ctx_prestamos_anual, years=YEARS),
    "ctx_seguros_anual": _dated(history.ctx_seguros_anual, years=YEARS),
    "ctx_metas_anual": _dated(history.ctx_metas_anual, years=YEARS),
    "ctx_cobros_anual": _dated(history.ctx_cobros_anual, years=YEARS),
    "ctx_tx_trimestral": _dated(history.ctx_tx_trimestral, years=YEARS[1:]),
    "ctx_cuentas_trimestral": _dated(history.ctx_cuentas_trimestral, years=YEARS[:2]),
    "ctx_tx_mensual": _dated(history.ctx_tx_mensual, years=YEARS[1:]),
    "ctx_prestamos_por_tipo": _dated(history.ctx_prestamos_por_tipo),
    "ctx_top5_sucursales": _dated(history.ctx_top5_sucursales),
    "ctx_scores": _dated(history.ctx_scores),
    "ctx_variacion_anual": _dated(history.ctx_variacion_anual, **_HISTORY),
    "ctx_anio_maximo": _dated(history.ctx_anio_maximo, **_HISTORY),
    "ctx_comparativa_trimestral": _dated(
        history.ctx_comparativa_trimestral, now=NOW, before=BEFORE
    ),
    # The accounts end in mid-2001, so the last quarter has nothing to compare.
    "ctx_comparativa_trimestral_cuentas": _dated(
        history.ctx_comparativa_trimestral_cuentas, now=2001, before=2000
    ),
    "ctx_comparativa_mensual": _dated(history.ctx_comparativa_mensual, now=NOW, before=BEFORE),
    "ctx_indicadores": _dated(history.ctx_indicadores),
    "ctx_utilizacion": _dated(history.ctx_utilizacion),
    "ctx_morosidad": _dated(history.ctx_morosidad),
    "ctx_pagos_por_estatus": _dated(history.ctx_pagos_por_estatus),
    "ctx_pagos_por_canal": _dated(history.ctx_pagos_por_canal),
    "ctx_seguros_por_estatus": _dated(history.ctx_seguros_por_estatus),
    "ctx_prima_anual": _dated(history.ctx_prima_anual),
    "ctx_notificaciones_por_canal": _dated(history.ctx_notificaciones_por_canal),
    "ctx_metas_por_estatus": _dated(history.ctx_metas_por_estatus),
    "ctx_metas_progreso": _dated(history.ctx_metas_progreso),
    "ctx_nomina": _dated(history.ctx_nomina),
    "ctx_segmentos": _dated(history.ctx_segmentos),
}

REPORT_QUERIES: dict[str, Query] = {
    "rep_nivel_fraude": _dated(report.rep_nivel_fraude),
    "rep_semaforo": _dated(report.rep_semaforo),
    "rep_series": _dated(report.rep_series),
    "rep_tarjetas": _dated(report.rep_tarjetas),
    "rep_reporte": _dated(report.rep_reporte),
}

# The plans that a stored daily aggregate can answer.
DAILY_QUERIES: dict[str, Query] = {
    "kpi_transacciones_por_categoria_diario": _from_days(kpis.kpi_transacciones_por_categoria),
    "kpi_transacciones_por_canal_diario": _from_days(kpis.kpi_transacciones_por_canal),
    "kpi_tendencia_diario": _from_days(kpis.kpi_tendencia),
    "kpi_canal_periodo_diario": _from_days(kpis.kpi_canal_periodo, **_PERIOD),
    "ctx_tx_anual_diario": _from_days(history.ctx_tx_anual, years=YEARS),
    "ctx_tx_trimestral_diario": _from_days(history.ctx_tx_trimestral, years=YEARS[1:]),
    "ctx_tx_mensual_diario": _from_days(history.ctx_tx_mensual, years=YEARS[1:]),
    "rep_series_diario": _from_days(report.rep_series),
    "rep_reporte_diario": _from_days(report.rep_reporte),
}

STREAM_QUERIES: dict[str, Query] = {
    "stream_totales_por_canal": _streamed(jobs.replay_channel_totals),
    "stream_velocidad_deslizante": _streamed(jobs.replay_sliding_velocity),
    "stream_velocidad_exacta": _streamed(jobs.replay_exact_velocity),
    "stream_reglas_sin_estado": _streamed(jobs.replay_stateless_rules),
}


def flat_profile(profile: DataFrame) -> DataFrame:
    """The nested profile as plain columns, for engines and files without structs."""
    return profile.select(
        "id_cliente", "nombre", "apellido_paterno", "apellido_materno", "genero",
        "fecha_nacimiento",
        F.col("datos_personales.email").alias("email"),
        F.col("datos_personales.ciudad").alias("ciudad"),
        F.col("datos_personales.estado").alias("estado"),
        F.col("datos_negocio.giro_negocio").alias("giro_negocio"),
        F.col("datos_negocio.num_empleados").alias("num_empleados"),
        F.col("datos_negocio.paga_nomina").alias("paga_nomina"),
        F.col("open_data.segmento_cliente").alias("segmento_cliente"),
        F.col("open_data.nivel_riesgo").alias("nivel_riesgo"),
        F.col("open_data.score_crediticio").alias("score_crediticio"),
        F.col("datos_negocio").isNotNull().alias("tiene_negocio"),
    )


def all_queries() -> dict[str, Query]:
    return {
        **KPI_QUERIES, **FRAUD_QUERIES, **LOOKUP_QUERIES, **HISTORY_QUERIES, **REPORT_QUERIES,
        **DAILY_QUERIES, **STREAM_QUERIES,
    }
