"""Declared schemas of the banking tables (DDL text, read with ``spark.read.schema``).

Timestamps are ``timestamp_ntz``: the bank stores wall-clock local time without a
zone, so hour-of-day and calendar-day rules never depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

_DDL = {
    "clientes": """
        id_cliente string, nombre string, apellido_paterno string, apellido_materno string,
        genero string, rfc string, curp string, fecha_nacimiento date, nacionalidad string,
        estado_civil string""",
    "datos_personales": """
        id_cliente string, email string, telefono_celular string, telefono_casa string,
        direccion_calle string, colonia string, ciudad string, estado string,
        codigo_postal string, pais string, latitud_habitual decimal(9,6),
        longitud_habitual decimal(9,6)""",
    "datos_negocio": """
        id_cliente string, razon_social string, rfc_negocio string, giro_negocio string,
        ingresos_anuales decimal(18,2), num_empleados int, paga_nomina boolean""",
    "open_data": """
        id_cliente string, segmento_cliente string, nivel_riesgo string, score_crediticio int,
        producto_estrella string""",
    "cuentas": """
        num_cuenta string, id_cliente string, tipo_cuenta string, clabe string, moneda string,
        saldo decimal(15,2), fecha_apertura date, fecha_cancelacion date, estatus string,
        sucursal string""",
    "transacciones": """
        id_transaccion string, id_cliente string, num_cuenta string, fecha timestamp_ntz,
        monto decimal(12,2), tipo string, categoria string, comercio string, canal string,
        latitud decimal(9,6), longitud decimal(9,6), es_fraude_potencial boolean""",
    "tarjetas": """
        num_tarjeta string, id_cliente string, tipo_tarjeta string, limite_credito decimal(12,2),
        saldo_tarjeta decimal(12,2), fecha_vencimiento string, estatus_tarjeta string,
        fecha_cancelacion date, fecha_ultimo_pago date, fecha_limite_pago date""",
    "prestamos": """
        id_prestamo string, id_cliente string, tipo_prestamo string, monto_prestamo decimal(15,2),
        tasa_prestamo decimal(5,2), plazo_meses int, saldo_prestamo decimal(15,2),
        fecha_otorgamiento date, estatus_prestamo string, sucursal string""",
    "seguros": """
        num_poliza string, id_cliente string, tipo_seguro string, prima_anual decimal(10,2),
        fecha_inicio date, fecha_vencimiento date, estatus_seguro string, fecha_cancelacion date""",
    "financiaciones": """
        id_financiacion int, id_cliente string, tipo_financiacion string,
        monto_financiado decimal(15,2), tasa_interes decimal(5,2), plazo_meses int,
        fecha_inicio date""",
    "cobros": """
        id_cobro string, id_cliente string, fecha_cobro date, monto_cobro decimal(10,2),
        tipo_cobro string, concepto_cobro string, estatus_cobro string,
        limite_legal decimal(10,2), excede_limite boolean""",
    "pagos": """
        id_pago string, id_cliente string, fecha_pago date, monto_pago decimal(12,2),
        tipo_pago string, concepto_pago string, estatus_pago string, banco_destino string,
        cuenta_destino string, referencia_pago string, canal_pago string""",
    "metas_ahorro": """
        id_meta string, id_cliente string, nombre_meta string, monto_objetivo decimal(12,2),
        monto_actual decimal(12,2), fecha_inicio date, fecha_objetivo date, estatus string""",
    "notificaciones": """
        id_notificacion string, id_cliente string, fecha_notificacion date,
        tipo_notificacion string, canal_notificacion string, estatus_notificacion string,
        mensaje_notificacion string""",
    "auditoria_comisiones": """
        id_auditoria int, id_cobro string, id_cliente string, fecha_auditoria date,
        tipo_comision string, monto_cobrado decimal(10,2), limite_legal decimal(10,2),
        diferencia decimal(10,2), resultado string""",
    "tipo_cambio": "fecha date, rate decimal(10,4)",
}

BANK_TABLES = tuple(name for name in _DDL if name != "tipo_cambio")

PRIMARY_KEYS = {
    "clientes": "id_cliente",
    "datos_personales": "id_cliente",
    "datos_negocio": "id_cliente",
    "open_data": "id_cliente",
    "cuentas": "num_cuenta",
    "transacciones": "id_transaccion",
    "tarjetas": "num_tarjeta",
    "prestamos": "id_prestamo",
    "seguros": "num_poliza",
    "financiaciones": "id_financiacion",
    "cobros": "id_cobro",
    "pagos": "id_pago",
    "metas_ahorro": "id_meta",
    "notificaciones": "id_notificacion",
    "auditoria_comisiones": "id_auditoria",
    "tipo_cambio": "fecha",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(_DDL[table])


# Columns of the fraud mart, used when a mart table has not been loaded yet.
MART_DDL = {
    "resumen_general": """
        total_transacciones bigint, total_fraudes bigint, tasa_fraude_pct double,
        monto_total_fraude double, monto_promedio_fraude double, monto_maximo_fraude double,
        monto_total_usd double, score_umbral int""",
    "fraude_por_categoria": "categoria string, total_fraudes bigint, monto_total double",
    "fraude_por_canal": "canal string, total_fraudes bigint, porcentaje double",
    "fraude_por_mes": "anio_mes string, total_fraudes bigint, monto_total double",
    "alertas_fraude": """
        id_transaccion string, id_cliente string, nombre string, apellido_paterno string,
        num_cuenta string, tipo_cuenta string, sucursal string, fecha timestamp_ntz,
        monto decimal(12,2), categoria string, comercio string, canal string,
        r1_geo boolean, r2_velocidad boolean, r3_monto boolean, r4_hora boolean,
        score int, tipo_cambio decimal(10,4), monto_usd decimal(18,2)""",
}


def mart_schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(MART_DDL[table])
