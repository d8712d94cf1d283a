"""Queries served to the fraud dashboard (E1-E8).

E1-E4 and E7 read the mart that the scoring pipeline loads. E5, E6 and E8 read the
transactions and their stored flag: the two notions of fraud are kept apart on purpose.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from caudal.functions.dates import instant, whole_days
from caudal.functions.numbers import as_double, count_true, pct_of_counts
from caudal.operators.ranking import page_after, page_info, page_of, top_k
from caudal.schemas import MART_DDL
from caudal.sources.sinks import VIEW_PREFIX
from caudal.sources.tables import Tables, table_or_empty


def mart_view(spark: SparkSession, name: str) -> DataFrame:
    """A loaded mart table, or an empty one of its shape before the first load."""
    return table_or_empty(spark, VIEW_PREFIX + name, MART_DDL[name])


def mart_views(spark: SparkSession) -> Tables:
    return Tables(lambda name: mart_view(spark, name))


def etl_resumen(mart: Tables) -> DataFrame:
    return mart["resumen_general"].limit(1)


def etl_fraude_por_categoria(mart: Tables) -> DataFrame:
    return mart["fraude_por_categoria"].orderBy(F.desc("total_fraudes"), "categoria")


def etl_fraude_por_canal(mart: Tables) -> DataFrame:
    return mart["fraude_por_canal"].orderBy(F.desc("total_fraudes"), "canal")


def etl_fraude_por_mes(mart: Tables) -> DataFrame:
    return mart["fraude_por_mes"].orderBy("anio_mes")


def etl_fraude_geografico(t: Tables, *, k: int = 200) -> DataFrame:
    """Flagged transactions by 0.1-degree cell: totals, and the commonest category and channel."""
    money = F.col("monto")
    cells = (
        t.transacciones.filter(
            F.col("es_fraude_potencial")
            & F.col("latitud").isNotNull()
            & F.col("longitud").isNotNull()
        )
        .groupBy(
            as_double(F.round("latitud", 1)).alias("lat"),
            as_double(F.round("longitud", 1)).alias("lng"),
        )
        .agg(
            F.count("*").alias("total_fraudes"),
            as_double(F.sum(money)).alias("monto_total"),
            F.try_divide(as_double(F.sum(money)), F.count(money)).alias("monto_promedio"),
            F.mode("categoria", True).alias("categoria_top"),
            F.mode("canal", True).alias("canal_top"),
        )
    )
    return top_k(cells, k, F.desc("total_fraudes"), "lat", "lng")


def etl_fraude_por_comercio(t: Tables, *, k: int = 20) -> DataFrame:
    """The merchants with most flagged transactions, and the clients they touch."""
    money = F.col("monto")
    merchants = (
        t.transacciones.filter(F.col("es_fraude_potencial") & F.col("comercio").isNotNull())
        .groupBy("comercio", "categoria")
        .agg(
            F.count("*").alias("total_fraudes"),
            as_double(F.sum(money)).alias("monto_total"),
            F.try_divide(as_double(F.sum(money)), F.count(money)).alias("monto_promedio"),
            F.count_distinct("id_cliente").alias("clientes_afectados"),
            F.max("fecha").alias("ultima_alerta"),
        )
    )
    return top_k(
        merchants, k, F.desc("total_fraudes"), "comercio", F.asc_nulls_last("categoria")
    )


def etl_alertas_fraude(mart: Tables, *, page: int, limit: int) -> DataFrame:
    """One page of alerts, newest first."""
    alerts = mart["alertas_fraude"]
    return page_of(alerts, page, limit, F.desc("fecha"), "id_transaccion")


def etl_alertas_fraude_info(mart: Tables, *, page: int, limit: int) -> DataFrame:
    return page_info(mart["alertas_fraude"], page, limit)


def etl_alertas_fraude_after(
    mart: Tables, *, fecha: str | dt.datetime, id_transaccion: str, limit: int
) -> DataFrame:
    """The page that follows a known last alert, at the cost of a first page."""
    at, last_id = F.col("fecha"), F.col("id_transaccion")
    beyond = (at < instant(fecha)) | ((at == instant(fecha)) & (last_id > id_transaccion))
    return page_after(mart["alertas_fraude"], limit, beyond, F.desc("fecha"), "id_transaccion")


def etl_resumen_periodo(t: Tables, *, desde: str | dt.date, hasta: str | dt.date) -> DataFrame:
    """Flagged transactions in the period: count, amount (NULL if none) and rate."""
    flagged = F.col("es_fraude_potencial")
    inside = t.transacciones.filter(whole_days(F.col("fecha"), desde, hasta))
    return inside.agg(
        count_true(flagged).alias("total_fraudes"),
        as_double(F.sum(F.when(flagged, F.col("monto")))).alias("monto_total"),
        pct_of_counts(count_true(flagged), F.count("*")).alias("tasa_fraude"),
    )
