"""The banking schema projected out of the TPC-H-style sample tables.

Each table is one source table and a list of column expressions. The expressions are plain
SQL that other engines read as well, so a checker can build the same tables on its own side.
They bring in NULL keys, NULL flags, NULL amounts and every status word on purpose.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from caudal.sources.tables import Tables

SAMPLE_DDL = {
    "customer": """c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,
        c_mktsegment string""",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
}

_CLIENTES = (
    "customer",
    [
        "'C' || CAST(c_custkey AS STRING) AS id_cliente",
        "c_name AS nombre",
        """CASE c_custkey % 7 WHEN 0 THEN 'García' WHEN 1 THEN 'Hernández' WHEN 2 THEN 'López'
           WHEN 3 THEN 'Martínez' WHEN 4 THEN 'Pérez' WHEN 5 THEN 'Ruiz' ELSE 'Soto' END
           AS apellido_paterno""",
        "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Vega' END AS apellido_materno",
        """CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'M' WHEN 2 THEN 'F' WHEN 3 THEN 'Otro'
           ELSE NULL END AS genero""",
        "DATE '1960-01-01' + CAST(c_custkey % 15000 AS INT) AS fecha_nacimiento",
    ],
)

_DATOS_PERSONALES = (
    "customer",
    [
        "'C' || CAST(c_custkey AS STRING) AS id_cliente",
        "lower(c_name) || '@correo.mx' AS email",
        "'Ciudad ' || CAST(c_nationkey AS STRING) AS ciudad",
        "'Estado ' || CAST(c_nationkey % 5 AS STRING) AS estado",
        """CASE WHEN c_custkey % 19 = 0 THEN NULL
           ELSE CAST(15 + (c_custkey * 7 % 1700) / 100.0 AS DECIMAL(9,6)) END AS latitud_habitual""",
        """CASE WHEN c_custkey % 19 = 0 THEN NULL
           ELSE CAST(-115 + (c_custkey * 13 % 2800) / 100.0 AS DECIMAL(9,6)) END AS longitud_habitual""",
    ],
)

_DATOS_NEGOCIO = (
    "supplier",
    [
        "'C' || CAST(s_suppkey AS STRING) AS id_cliente",
        "CASE s_suppkey % 3 WHEN 0 THEN 'Comercio' WHEN 1 THEN 'Servicios' ELSE 'Industria' END AS giro_negocio",
        "CAST(s_acctbal AS DECIMAL(18,2)) AS ingresos_anuales",
        "CAST(s_suppkey % 250 AS INT) AS num_empleados",
        """CASE s_suppkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE
           ELSE NULL END AS paga_nomina""",
    ],
)

_OPEN_DATA = (
    "customer",
    [
        "'C' || CAST(c_custkey AS STRING) AS id_cliente",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS segmento_cliente",
        """CASE WHEN c_acctbal < 1000 THEN 'Alto' WHEN c_acctbal < 5000 THEN 'Medio' ELSE 'Bajo' END
           AS nivel_riesgo""",
        """CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(300 + (c_custkey * 37) % 550 AS INT) END
           AS score_crediticio""",
    ],
)

_CUENTAS = (
    "orders",
    [
        "'A' || CAST(o_orderkey AS STRING) AS num_cuenta",
        "'C' || CAST(o_custkey AS STRING) AS id_cliente",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'Ahorro' WHEN '2-HIGH' THEN 'Nómina'
           WHEN '3-MEDIUM' THEN 'Cheques' WHEN '4-NOT SPECIFIED' THEN 'Inversión' ELSE NULL END
           AS tipo_cuenta""",
        "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS saldo",
        "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha_apertura",
        """CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'Activa'
           WHEN o_orderstatus = 'F' THEN 'Cancelada' ELSE 'Suspendida' END AS estatus""",
        """CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'S' || CAST(o_orderkey % 40 AS STRING) END
           AS sucursal""",
    ],
)

_TRANSACCIONES = (
    "lineitem",
    [
        """'L' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
           || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
           || substr(CAST(l_shipdate AS STRING), 1, 10) AS id_transaccion""",
        "'C' || CAST(CAST(floor(l_orderkey / 10) AS BIGINT) AS STRING) AS id_cliente",
        """CASE WHEN l_orderkey % 43 = 0 THEN NULL ELSE 'A' || CAST(l_orderkey AS STRING) END
           AS num_cuenta""",
        "l_shipdate AS fecha",
        """CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END
           AS monto""",
        """CASE l_linenumber % 4 WHEN 0 THEN 'Compra' WHEN 1 THEN 'Retiro'
           WHEN 2 THEN 'Transferencia' ELSE 'Depósito' END AS tipo""",
        """CASE l_partkey % 11 WHEN 0 THEN 'Supermercado' WHEN 1 THEN 'Restaurante' WHEN 2 THEN 'Gasolina'
           WHEN 3 THEN 'Salud' WHEN 4 THEN 'Viajes' WHEN 5 THEN 'Ropa' WHEN 6 THEN 'Educación'
           WHEN 7 THEN 'Hogar' WHEN 8 THEN 'Ocio' WHEN 9 THEN 'Servicios' ELSE NULL END AS categoria""",
        """CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE 'Comercio ' || CAST(l_suppkey AS STRING) END
           AS comercio""",
        """CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'App' WHEN 'AO' THEN 'Web'
           WHEN 'AF' THEN 'Sucursal' WHEN 'NF' THEN 'Cajero' WHEN 'NO' THEN 'Teléfono' ELSE NULL END
           AS canal""",
        """CASE WHEN l_partkey % 53 = 0 THEN NULL
           ELSE CAST(15 + (l_orderkey * 7 % 1700) / 100.0 AS DECIMAL(9,6)) END AS latitud""",
        """CASE WHEN l_partkey % 59 = 0 THEN NULL
           ELSE CAST(-115 + (l_suppkey * 13 % 2800) / 100.0 AS DECIMAL(9,6)) END AS longitud""",
        """CASE WHEN l_discount < 0.005 THEN NULL WHEN l_discount > 0.085 THEN TRUE ELSE FALSE END
           AS es_fraude_potencial""",
    ],
)

# Transactions with real times of day, for the hour and velocity rules.
_TRANSACCIONES_CON_HORA = (
    "events",
    [
        "'E' || CAST(event_id AS STRING) AS id_transaccion",
        "'C' || CAST(user_id AS STRING) AS id_cliente",
        """CASE WHEN event_id % 43 = 0 THEN NULL ELSE 'A' || CAST(user_id * 10 + event_id % 10 AS STRING)
           END AS num_cuenta""",
        # Six hours fold into one, so that one hour holds several transactions of a client.
        "ts - INTERVAL '1' HOUR * (hour(ts) % 6 - 1) AS fecha",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(value AS DECIMAL(12,2)) END AS monto",
        """CASE event_id % 4 WHEN 0 THEN 'Compra' WHEN 1 THEN 'Retiro'
           WHEN 2 THEN 'Transferencia' ELSE 'Depósito' END AS tipo""",
        """CASE event_id % 11 WHEN 0 THEN 'Supermercado' WHEN 1 THEN 'Restaurante' WHEN 2 THEN 'Gasolina'
           WHEN 3 THEN 'Salud' WHEN 4 THEN 'Viajes' WHEN 5 THEN 'Ropa' WHEN 6 THEN 'Educación'
           WHEN 7 THEN 'Hogar' WHEN 8 THEN 'Ocio' WHEN 9 THEN 'Servicios' ELSE NULL END AS categoria""",
        "'Comercio ' || CAST(event_id % 211 AS STRING) AS comercio",
        """CASE event_type WHEN 'view' THEN 'App' WHEN 'click' THEN 'Web' WHEN 'purchase' THEN 'Sucursal'
           WHEN 'signup' THEN 'Cajero' ELSE NULL END AS canal""",
        """CASE WHEN event_id % 53 = 0 THEN NULL
           ELSE CAST(15 + (user_id * 7 % 1700) / 100.0 + (event_id % 41) / 40.0 AS DECIMAL(9,6)) END
           AS latitud""",
        """CASE WHEN event_id % 59 = 0 THEN NULL
           ELSE CAST(-115 + (user_id * 13 % 2800) / 100.0 + (event_id % 7) / 40.0 AS DECIMAL(9,6)) END
           AS longitud""",
        """CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 25 = 0 THEN TRUE ELSE FALSE END
           AS es_fraude_potencial""",
    ],
)

_TARJETAS = (
    "customer",
    [
        "'T' || CAST(c_custkey AS STRING) AS num_tarjeta",
        "'C' || CAST(c_custkey AS STRING) AS id_cliente",
        """CASE c_custkey % 4 WHEN 0 THEN 'Clásica' WHEN 1 THEN 'Oro' WHEN 2 THEN 'Platino' ELSE NULL END
           AS tipo_tarjeta""",
        """CASE WHEN c_custkey % 10 = 0 THEN CAST(0 AS DECIMAL(12,2))
           ELSE CAST(5000 + (c_custkey * 791) % 95000 AS DECIMAL(12,2)) END AS limite_credito""",
        "CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS saldo_tarjeta",
        """CASE c_custkey % 7 WHEN 0 THEN 'Bloqueada' WHEN 1 THEN 'Cancelada' WHEN 2 THEN NULL
           ELSE 'Activa' END AS estatus_tarjeta""",
    ],
)

_PRESTAMOS = (
    "orders",
    [
        "'P' || CAST(o_orderkey AS STRING) AS id_prestamo",
        "'C' || CAST(o_custkey AS STRING) AS id_cliente",
        """CASE o_orderkey % 6 WHEN 0 THEN 'Hipotecario' WHEN 1 THEN 'Auto' WHEN 2 THEN 'Personal'
           WHEN 3 THEN 'Nómina' WHEN 4 THEN 'Pyme' ELSE NULL END AS tipo_prestamo""",
        "CAST(o_totalprice AS DECIMAL(15,2)) AS monto_prestamo",
        """CASE WHEN o_orderkey % 47 = 0 THEN NULL
           ELSE CAST(8 + (o_orderkey % 2500) / 100.0 AS DECIMAL(5,2)) END AS tasa_prestamo""",
        """CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(15,2)) END
           AS saldo_prestamo""",
        "CAST(o_orderdate AS DATE) AS fecha_otorgamiento",
        """CASE o_orderkey % 7 WHEN 0 THEN 'Vigente' WHEN 1 THEN 'Al corriente' WHEN 2 THEN 'Vencido'
           WHEN 3 THEN 'En reestructura' WHEN 4 THEN 'Liquidado' WHEN 5 THEN 'Vigente' ELSE NULL END
           AS estatus_prestamo""",
    ],
)

_SEGUROS = (
    "part",
    [
        "'Z' || CAST(p_partkey AS STRING) AS num_poliza",
        "'C' || CAST(p_partkey AS STRING) AS id_cliente",
        "p_type AS tipo_seguro",
        "CASE WHEN p_partkey % 14 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS prima_anual",
        "DATE '1995-06-01' + CAST(p_partkey % 1400 AS INT) AS fecha_inicio",
        """CASE p_size % 4 WHEN 0 THEN 'Activo' WHEN 1 THEN 'Cancelado' WHEN 2 THEN 'Activo' ELSE NULL END
           AS estatus_seguro""",
    ],
)

_FINANCIACIONES = (
    "orders",
    [
        "CAST(o_orderkey AS INT) AS id_financiacion",
        "'C' || CAST(o_custkey AS STRING) AS id_cliente",
        "CASE o_orderkey % 2 WHEN 0 THEN 'Arrendamiento' ELSE 'Factoraje' END AS tipo_financiacion",
        "CAST(o_totalprice AS DECIMAL(15,2)) AS monto_financiado",
        "CAST(o_orderdate AS DATE) AS fecha_inicio",
    ],
)

_COBROS = (
    "lineitem",
    [
        "'B' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id_cobro",
        "'C' || CAST(CAST(floor(l_orderkey / 10) AS BIGINT) AS STRING) AS id_cliente",
        "CAST(l_shipdate AS DATE) AS fecha_cobro",
        "CAST(l_quantity AS DECIMAL(10,2)) AS monto_cobro",
        """CASE WHEN l_partkey % 61 = 0 THEN NULL WHEN l_tax > 0.065 THEN TRUE ELSE FALSE END
           AS excede_limite""",
    ],
)

_PAGOS = (
    "orders",
    [
        "'G' || CAST(o_orderkey AS STRING) AS id_pago",
        "'C' || CAST(o_custkey AS STRING) AS id_cliente",
        "CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS fecha_pago",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS monto_pago",
        """CASE WHEN o_orderkey % 73 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN 'EXITOSO'
           WHEN o_orderstatus = 'O' THEN 'Exitoso' WHEN o_orderstatus = 'F' THEN 'Fallido'
           ELSE 'Pendiente' END AS estatus_pago""",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'App' WHEN '2-HIGH' THEN 'Web'
           WHEN '3-MEDIUM' THEN 'Sucursal' WHEN '4-NOT SPECIFIED' THEN 'Cajero' ELSE NULL END
           AS canal_pago""",
    ],
)

_METAS_AHORRO = (
    "customer",
    [
        "'M' || CAST(c_custkey AS STRING) AS id_meta",
        "'C' || CAST(c_custkey AS STRING) AS id_cliente",
        """CASE WHEN c_custkey % 12 = 0 THEN CAST(0 AS DECIMAL(12,2))
           ELSE CAST(1000 + (c_custkey * 53) % 90000 AS DECIMAL(12,2)) END AS monto_objetivo""",
        "CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS monto_actual",
        "DATE '1995-06-01' + CAST(c_custkey % 1400 AS INT) AS fecha_inicio",
        """CASE WHEN c_custkey % 16 = 0 THEN NULL
           ELSE DATE '1998-01-01' + CAST(c_custkey % 900 AS INT) END AS fecha_objetivo""",
        """CASE c_custkey % 6 WHEN 0 THEN 'Activa' WHEN 1 THEN 'En progreso' WHEN 2 THEN 'Completada'
           WHEN 3 THEN 'Fallida' WHEN 4 THEN 'COMPLETADA' ELSE NULL END AS estatus""",
    ],
)

_NOTIFICACIONES = (
    "events",
    [
        "'N' || CAST(event_id AS STRING) AS id_notificacion",
        "'C' || CAST(user_id AS STRING) AS id_cliente",
        """CASE event_type WHEN 'view' THEN 'Push' WHEN 'click' THEN 'SMS' WHEN 'purchase' THEN 'Email'
           WHEN 'signup' THEN 'WhatsApp' ELSE NULL END AS canal_notificacion""",
        """CASE event_id % 5 WHEN 0 THEN 'Entregada' WHEN 1 THEN 'Leída' WHEN 2 THEN 'Fallida'
           WHEN 3 THEN 'Entregada' ELSE NULL END AS estatus_notificacion""",
    ],
)

_AUDITORIA_COMISIONES = (
    "lineitem",
    [
        "CAST(l_orderkey * 7 + l_linenumber AS INT) AS id_auditoria",
        "'B' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS id_cobro",
        "'C' || CAST(CAST(floor(l_orderkey / 10) AS BIGINT) AS STRING) AS id_cliente",
        """CASE l_returnflag WHEN 'R' THEN 'Anualidad' WHEN 'A' THEN 'Manejo de cuenta' ELSE NULL END
           AS tipo_comision""",
        "CAST(l_quantity AS DECIMAL(10,2)) AS diferencia",
        "CASE WHEN l_discount > 0.065 THEN 'Excede' ELSE 'Correcto' END AS resultado",
    ],
)

PROJECTIONS = {
    "clientes": _CLIENTES,
    "datos_personales": _DATOS_PERSONALES,
    "datos_negocio": _DATOS_NEGOCIO,
    "open_data": _OPEN_DATA,
    "cuentas": _CUENTAS,
    "transacciones": _TRANSACCIONES,
    "transacciones_con_hora": _TRANSACCIONES_CON_HORA,
    "tarjetas": _TARJETAS,
    "prestamos": _PRESTAMOS,
    "seguros": _SEGUROS,
    "financiaciones": _FINANCIACIONES,
    "cobros": _COBROS,
    "pagos": _PAGOS,
    "metas_ahorro": _METAS_AHORRO,
    "notificaciones": _NOTIFICACIONES,
    "auditoria_comisiones": _AUDITORIA_COMISIONES,
}


def read_sample(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SAMPLE_DDL[table]).parquet(os.path.join(sf_dir, f"{table}.parquet"))


def exchange_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value of each day, as a rate."""
    return (
        read_sample(spark, sf_dir, "events")
        .selectExpr("CAST(ts AS DATE) AS fecha", "CAST(value AS DECIMAL(12,2)) AS v")
        .groupBy("fecha")
        .agg({"v": "sum", "*": "count"})
        .selectExpr("fecha", "CAST(`sum(v)` / `count(1)` AS DECIMAL(10,4)) AS rate")
    )


def sample_bank(spark: SparkSession, sf_dir: str, *, timed: bool = False) -> Tables:
    """The banking tables of one sample folder.

    ``timed`` takes the transactions from ``events`` (one month, real times of day)
    instead of ``lineitem`` (seven years, dates only).
    """

    def open_table(name: str) -> DataFrame:
        if name == "tipo_cambio":
            return exchange_rates(spark, sf_dir)
        if name == "transacciones" and timed:
            name = "transacciones_con_hora"
        source, columns = PROJECTIONS[name]
        return read_sample(spark, sf_dir, source).selectExpr(*columns)

    return Tables(open_table)
