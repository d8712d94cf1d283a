"""One SQL statement per registered query.

The logic is written on its own; only the fixed texts (labels, messages) are the plans'.
"""

from __future__ import annotations

from caudal.functions import text
from caudal.plans import history, kpis, report
from oracle.bank import bank, cents, half_up, pct, query

DESDE, HASTA = "DATE '1996-02-10'", "DATE '1998-07-15'"
YEARS = (1996, 1997, 1998)

# ── KPIs ────────────────────────────────────────────────────────────────────────────────


def share(source: str, column: str, name: str, out: str = "porcentaje") -> str:
    return query(
        bank(source),
        f"""SELECT {column} AS {name}, count(*) AS total,
                   {pct('count(*)', f'(SELECT count({column}) FROM {source})')} AS {out}
            FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}""",
    )


def volume(column: str, where: str = "") -> str:
    return query(
        bank("transacciones"),
        f"""SELECT {column}, count(*) AS total, CAST(sum(monto) AS DOUBLE) AS monto_total
            FROM transacciones WHERE {column} IS NOT NULL {where} GROUP BY {column}""",
    )


RESUMEN = """
    SELECT (SELECT count(*) FROM clientes) AS totalClientes,
           (SELECT count(*) FROM cuentas WHERE estatus = 'Activa') AS cuentasActivas,
           (SELECT CAST(coalesce(sum(saldo), 0) AS DOUBLE) FROM cuentas WHERE estatus = 'Activa')
               AS saldoTotalCuentas,
           (SELECT count(*) FROM prestamos WHERE estatus_prestamo = 'Vigente') AS prestamosActivos,
           (SELECT CAST(coalesce(sum(saldo_prestamo), 0) AS DOUBLE) FROM prestamos
               WHERE estatus_prestamo = 'Vigente') AS montoPrestamosVigentes,
           (SELECT count(*) FROM transacciones
               WHERE fecha >= (SELECT date_trunc('day', max(fecha)) FROM transacciones)) AS transaccionesHoy,
           (SELECT count(*) FROM transacciones WHERE es_fraude_potencial) AS fraudesPotenciales,
           (SELECT count(*) FROM cobros WHERE excede_limite) AS cobrosExcedidos"""

DEBILIDADES = f"""
    SELECT (SELECT coalesce({pct('sum(CASE WHEN es_fraude_potencial THEN 1 ELSE 0 END)', 'count(*)')}, 0)
               FROM transacciones) AS porcentajeFraudePotencial,
           (SELECT coalesce({pct('sum(CASE WHEN excede_limite THEN 1 ELSE 0 END)', 'count(*)')}, 0)
               FROM cobros) AS porcentajeCobrosExcedidos,
           (SELECT coalesce({pct("count(*) FILTER (WHERE estatus = 'Cancelada')", 'count(*)')}, 0)
               FROM cuentas) AS porcentajeCuentasCanceladas,
           (SELECT coalesce({pct("count(*) FILTER (WHERE estatus_prestamo = 'Vencido')",
                                 "count(*) FILTER (WHERE estatus_prestamo <> 'Liquidado')")}, 0)
               FROM prestamos) AS porcentajePrestamosVencidos,
           (SELECT coalesce({pct("count(*) FILTER (WHERE estatus = 'Fallida')", 'count(*)')}, 0)
               FROM metas_ahorro) AS porcentajeMetasFallidas"""

RISK_TABLES = ("transacciones", "cobros", "cuentas", "prestamos", "metas_ahorro")


def number_text(value: str) -> str:
    return rf"regexp_replace(CAST(CAST({value} AS DECIMAL(20,2)) AS VARCHAR), '\.?0+$', '')"


def risks(*extra: tuple[str, str]) -> list[tuple[str, str]]:
    return [*bank(*RISK_TABLES), ("debilidades", DEBILIDADES), *extra]


# The limits in percent, written here and not taken from the code under test.
LIMITS = {
    "porcentajeFraudePotencial": 5, "porcentajeCobrosExcedidos": 10,
    "porcentajeCuentasCanceladas": 20, "porcentajePrestamosVencidos": 15,
    "porcentajeMetasFallidas": 30,
}

SOLUCIONES = " UNION ALL ".join(
    f"""SELECT '{area}' AS area, {number_text(column)} || '{problem}' AS problema,
               '{solution}' AS solucion, '{priority}' AS prioridad
        FROM debilidades WHERE {column} > {LIMITS[column]}"""
    for column, _, area, problem, solution, priority in kpis.INDICADORES
)


def score_ranges(labels: tuple[str, ...]) -> str:
    a, b, c, d = labels
    return f"""SELECT CASE WHEN score_crediticio < 500 THEN '{a}' WHEN score_crediticio < 650 THEN '{b}'
                      WHEN score_crediticio < 750 THEN '{c}' ELSE '{d}' END AS rango, count(*) AS total
               FROM open_data WHERE score_crediticio IS NOT NULL GROUP BY 1"""



TENDENCIA = """
    SELECT strftime(fecha, '%Y-%m') AS mes, count(*) AS total, CAST(sum(monto) AS DOUBLE) AS monto_total
    FROM transacciones
    WHERE fecha >= (SELECT max(fecha) FROM transacciones) - INTERVAL 12 MONTH
    GROUP BY 1"""

CARDS_IN_USE = "estatus_tarjeta = 'Activa' AND limite_credito > 0"


def utilization(util: str, cards: str, balance: str, limit: str) -> str:
    return query(bank("tarjetas"), f"""
        SELECT {half_up('100 * ' + cents('sum(saldo_tarjeta)'), cents('sum(limite_credito)'))} AS {util},
               count(*) AS {cards}, CAST(sum(saldo_tarjeta) AS DOUBLE) AS {balance},
               CAST(sum(limite_credito) AS DOUBLE) AS {limit}
        FROM tarjetas WHERE {CARDS_IN_USE}""")


def delinquency(active: str, blocked: str, rate: str) -> str:
    return query(bank("tarjetas"), f"""
        SELECT count(*) FILTER (WHERE estatus_tarjeta IN ('Activa', 'Bloqueada')) AS {active},
               count(*) FILTER (WHERE estatus_tarjeta = 'Bloqueada') AS {blocked},
               {pct("count(*) FILTER (WHERE estatus_tarjeta = 'Bloqueada')",
                    "count(*) FILTER (WHERE estatus_tarjeta IN ('Activa', 'Bloqueada'))")} AS {rate}
        FROM tarjetas""")


def premium(mean: str, total: str, policies: str) -> str:
    return query(bank("seguros"), f"""
        SELECT {half_up(cents('sum(prima_anual)'), '100 * count(*)')} AS {mean},
               CAST(sum(prima_anual) AS DOUBLE) AS {total}, count(*) AS {policies}
        FROM seguros WHERE estatus_seguro = 'Activo' AND prima_anual IS NOT NULL""")


def goals(progress: str, active: str, target: str, saved: str) -> str:
    return query(bank("metas_ahorro"), f"""
        SELECT round(100 * avg(CAST(monto_actual AS DOUBLE) / CAST(monto_objetivo AS DOUBLE)), 2) AS {progress},
               count(*) AS {active}, CAST(sum(monto_objetivo) AS DOUBLE) AS {target},
               CAST(sum(monto_actual) AS DOUBLE) AS {saved}
        FROM metas_ahorro WHERE estatus IN ('Activa', 'En progreso') AND monto_objetivo > 0""")


def within(column: str, lo: str = DESDE, hi: str = HASTA) -> str:
    return f"CAST({column} AS DATE) BETWEEN {lo} AND {hi}"


KPIS = {
    "kpi_resumen": query(bank("clientes", "cuentas", "prestamos", "transacciones", "cobros"), RESUMEN),
    "kpi_clientes_por_segmento": query(bank("open_data"), """
        SELECT segmento_cliente AS segmento, count(*) AS total FROM open_data
        WHERE segmento_cliente IS NOT NULL GROUP BY 1"""),
    "kpi_clientes_por_genero": query(bank("clientes"), """
        SELECT genero, count(*) AS total FROM clientes WHERE genero IS NOT NULL GROUP BY 1"""),
    "kpi_transacciones_por_categoria": volume("categoria"),
    "kpi_transacciones_por_canal": volume("canal"),
    "kpi_tendencia": query(bank("transacciones"), TENDENCIA),
    "kpi_prestamos_por_tipo": query(bank("prestamos"), """
        SELECT tipo_prestamo AS tipo, count(*) AS total, CAST(sum(saldo_prestamo) AS DOUBLE) AS saldo_total
        FROM prestamos WHERE tipo_prestamo IS NOT NULL GROUP BY 1"""),
    "kpi_saldo_por_tipo_cuenta": query(bank("cuentas"), """
        SELECT tipo_cuenta AS tipo, count(*) AS total_cuentas, CAST(sum(saldo) AS DOUBLE) AS saldo_total
        FROM cuentas WHERE estatus = 'Activa' AND tipo_cuenta IS NOT NULL GROUP BY 1"""),
    "kpi_score_crediticio": query(bank("open_data"), score_ranges(kpis.SCORE_LABELS)),
    "kpi_cobros_excedidos": query(bank("auditoria_comisiones"), """
        SELECT tipo_comision AS tipo, count(*) AS total, CAST(sum(diferencia) AS DOUBLE) AS diferencia_total
        FROM auditoria_comisiones WHERE resultado = 'Excede' GROUP BY 1"""),
    "kpi_debilidades": query(risks(), "SELECT * FROM debilidades"),
    "kpi_soluciones": query(risks(), SOLUCIONES),
    "kpi_pagos_por_estatus": share("pagos", "estatus_pago", "estatus"),
    "kpi_pagos_por_canal": share("pagos", "canal_pago", "canal"),
    "kpi_seguros_por_estatus": share("seguros", "estatus_seguro", "estatus"),
    "kpi_prima_anual": premium("prima_promedio", "prima_total", "total_polizas"),
    "kpi_notificaciones_por_estatus": share("notificaciones", "estatus_notificacion", "estatus"),
    "kpi_notificaciones_por_canal": share("notificaciones", "canal_notificacion", "canal"),
    "kpi_cuentas_por_sucursal": query(bank("cuentas"), """
        SELECT sucursal, count(*) AS nuevas_cuentas FROM cuentas WHERE sucursal IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
    "kpi_nomina_resumen": query(bank("datos_negocio"), f"""
        SELECT count(*) AS total_empresas, count(*) FILTER (WHERE paga_nomina = true) AS con_nomina,
               count(*) FILTER (WHERE paga_nomina = false OR paga_nomina IS NULL) AS sin_nomina,
               {pct('count(*) FILTER (WHERE paga_nomina = true)', 'count(*)')} AS porcentaje_penetracion
        FROM datos_negocio"""),
    "kpi_utilizacion_credito": query(bank("tarjetas"), f"""
        SELECT tipo_tarjeta, count(*) AS total_tarjetas,
               round(100 * avg(CAST(saldo_tarjeta AS DOUBLE) / CAST(limite_credito AS DOUBLE)), 2)
                   AS utilizacion_promedio,
               CAST(sum(saldo_tarjeta) AS DOUBLE) AS saldo_total,
               CAST(sum(limite_credito) AS DOUBLE) AS limite_total
        FROM tarjetas WHERE {CARDS_IN_USE} AND tipo_tarjeta IS NOT NULL GROUP BY 1"""),
    "kpi_utilizacion_credito_resumen": utilization(
        "utilizacion_global", "total_tarjetas", "saldo_total", "limite_total"),
    "kpi_morosidad_tarjetas": query(bank("tarjetas"), f"""
        SELECT tipo_tarjeta, count(*) AS total,
               count(*) FILTER (WHERE estatus_tarjeta = 'Bloqueada') AS morosas,
               count(*) FILTER (WHERE estatus_tarjeta = 'Activa') AS al_corriente,
               {pct("count(*) FILTER (WHERE estatus_tarjeta = 'Bloqueada')", 'count(*)')} AS tasa_morosidad
        FROM tarjetas WHERE tipo_tarjeta IS NOT NULL AND estatus_tarjeta IN ('Activa', 'Bloqueada')
        GROUP BY 1"""),
    "kpi_morosidad_tarjetas_resumen": delinquency("total_activas", "total_morosas", "tasa_morosidad"),
    "kpi_tasa_interes_prestamos": query(bank("prestamos"), f"""
        SELECT tipo_prestamo, count(*) AS total,
               {half_up(cents('sum(tasa_prestamo)'), '100 * count(*)')} AS tasa_promedio,
               CAST(min(tasa_prestamo) AS DOUBLE) AS tasa_minima,
               CAST(max(tasa_prestamo) AS DOUBLE) AS tasa_maxima,
               CAST(sum(monto_prestamo) AS DOUBLE) AS monto_total
        FROM prestamos
        WHERE estatus_prestamo IN ('Al corriente', 'Vencido', 'En reestructura')
          AND tipo_prestamo IS NOT NULL AND tasa_prestamo IS NOT NULL GROUP BY 1"""),
    "kpi_metas_ahorro_por_estatus": share("metas_ahorro", "estatus", "estatus"),
    "kpi_metas_ahorro_progreso": goals(
        "progreso_promedio", "total_activas", "monto_objetivo_total", "monto_actual_total"),
    "kpi_resumen_periodo": query(
        bank("clientes", "cuentas", "prestamos", "transacciones", "cobros"), f"""
        SELECT (SELECT count(*) FROM clientes c WHERE EXISTS (SELECT 1 FROM cuentas a
                   WHERE a.id_cliente = c.id_cliente AND a.fecha_apertura <= {HASTA})) AS totalClientes,
               (SELECT count(*) FROM cuentas WHERE estatus = 'Activa' AND fecha_apertura <= {HASTA})
                   AS cuentasActivas,
               (SELECT CAST(coalesce(sum(saldo), 0) AS DOUBLE) FROM cuentas
                   WHERE estatus = 'Activa' AND fecha_apertura <= {HASTA}) AS saldoTotalCuentas,
               (SELECT count(*) FROM transacciones WHERE {within('fecha')}) AS transacciones,
               (SELECT CAST(coalesce(sum(monto), 0) AS DOUBLE) FROM transacciones WHERE {within('fecha')})
                   AS montoTransacciones,
               (SELECT count(*) FROM transacciones WHERE es_fraude_potencial AND {within('fecha')})
                   AS fraudesPotenciales,
               (SELECT count(*) FROM cobros WHERE excede_limite AND {within('fecha_cobro')}) AS cobrosExcedidos,
               (SELECT count(*) FROM prestamos WHERE estatus_prestamo = 'Vigente'
                   AND {within('fecha_otorgamiento')}) AS prestamosActivos,
               (SELECT CAST(coalesce(sum(saldo_prestamo), 0) AS DOUBLE) FROM prestamos
                   WHERE estatus_prestamo = 'Vigente' AND {within('fecha_otorgamiento')}) AS montoPrestamos"""),
    "kpi_clientes_nuevos": query(bank("cuentas"), f"""
        SELECT count(*) AS nuevos FROM (SELECT id_cliente FROM cuentas
        WHERE {within('fecha_apertura')} GROUP BY id_cliente)"""),
    "kpi_prestamos_periodo": query(bank("prestamos"), f"""
        SELECT tipo_prestamo AS tipoPrestamo, count(*) AS total,
               CAST(sum(saldo_prestamo) AS DOUBLE) AS saldo_total
        FROM prestamos WHERE {within('fecha_otorgamiento')} GROUP BY 1"""),
    "kpi_canal_periodo": volume("canal", f"AND {within('fecha')}"),
}

# ── fraud ───────────────────────────────────────────────────────────────────────────────

HAVERSINE = """CASE WHEN latitud IS NULL OR longitud IS NULL OR latitud_habitual IS NULL
    OR longitud_habitual IS NULL THEN NULL ELSE 2 * 6371.0 * asin(sqrt(least(1.0,
    power(sin((radians(CAST(latitud_habitual AS DOUBLE)) - radians(CAST(latitud AS DOUBLE))) / 2), 2)
    + cos(radians(CAST(latitud AS DOUBLE))) * cos(radians(CAST(latitud_habitual AS DOUBLE)))
    * power(sin((radians(CAST(longitud_habitual AS DOUBLE)) - radians(CAST(longitud AS DOUBLE))) / 2), 2)))) END"""

# A trailing window (t - 1 h, t] per client, ties included, as a plain range frame.
SCORED = f"""
    SELECT x.*, r1_pts + r2_pts + r3_pts + r4_pts AS score FROM (
        SELECT t.*, c.nombre, c.apellido_paterno,
               coalesce({HAVERSINE} > 100, false) AS r1_geo,
               en_ventana > 3 AS r2_velocidad,
               coalesce((CAST(monto AS DOUBLE) - media) / nullif(desviacion, 0) > 3, false) AS r3_monto,
               hour(fecha) BETWEEN 1 AND 4 AS r4_hora,
               CASE WHEN coalesce({HAVERSINE} > 100, false) THEN 3 ELSE 0 END AS r1_pts,
               CASE WHEN en_ventana > 3 THEN 2 ELSE 0 END AS r2_pts,
               CASE WHEN coalesce((CAST(monto AS DOUBLE) - media) / nullif(desviacion, 0) > 3, false)
                   THEN 2 ELSE 0 END AS r3_pts,
               CASE WHEN hour(fecha) BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS r4_pts
        FROM (
            SELECT *,
                   count(*) OVER (PARTITION BY id_cliente ORDER BY fecha
                       RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS en_ventana,
                   avg(CAST(monto AS DOUBLE)) OVER (PARTITION BY id_cliente) AS media,
                   stddev_samp(CAST(monto AS DOUBLE)) OVER (PARTITION BY id_cliente) AS desviacion
            FROM transacciones
        ) t
        JOIN clientes c USING (id_cliente)
        LEFT JOIN datos_personales p USING (id_cliente)
    ) x"""

ALERTS = """
    SELECT s.id_transaccion, s.id_cliente, s.nombre, s.apellido_paterno, s.num_cuenta, a.tipo_cuenta,
           a.sucursal, s.fecha, s.monto, s.categoria, s.comercio, s.canal, s.r1_geo, s.r2_velocidad,
           s.r3_monto, s.r4_hora, s.score, f.rate AS tipo_cambio,
           CAST((20000 * CAST(s.monto * 100 AS HUGEINT) + CAST(f.rate * 10000 AS HUGEINT))
                // (2 * CAST(f.rate * 10000 AS HUGEINT)) AS DECIMAL(20,0)) AS usd_cents
    FROM puntuadas s
    LEFT JOIN cuentas a ON a.num_cuenta = s.num_cuenta
    ASOF LEFT JOIN tipo_cambio f ON CAST(s.fecha AS DATE) >= f.fecha
    WHERE s.score >= 3"""


def alerts(body: str) -> str:
    return query(
        [*bank("transacciones", "clientes", "datos_personales", "cuentas", "tipo_cambio", timed=True),
         ("puntuadas", SCORED), ("alertas", ALERTS)],
        body,
    )


ALERT_COLUMNS = """id_transaccion, id_cliente, nombre, apellido_paterno, num_cuenta, tipo_cuenta, sucursal,
    fecha, monto, categoria, comercio, canal, r1_geo, r2_velocidad, r3_monto, r4_hora, score,
    tipo_cambio, CAST(usd_cents / 100 AS DECIMAL(18,2)) AS monto_usd"""

SUMMARY = alerts(f"""
    SELECT (SELECT count(*) FROM transacciones) AS total_transacciones, count(*) AS total_fraudes,
           {pct('count(*)', '(SELECT count(*) FROM transacciones)')} AS tasa_fraude_pct,
           CAST(sum(monto) AS DOUBLE) AS monto_total_fraude,
           CAST(sum(monto) AS DOUBLE) / count(monto) AS monto_promedio_fraude,
           CAST(max(monto) AS DOUBLE) AS monto_maximo_fraude,
           CAST(sum(usd_cents) AS DOUBLE) / 100 AS monto_total_usd, 3 AS score_umbral
    FROM alertas""")
BY_CATEGORY = alerts("""
    SELECT categoria, count(*) AS total_fraudes, CAST(sum(monto) AS DOUBLE) AS monto_total
    FROM alertas GROUP BY 1""")
BY_CHANNEL = alerts(f"""
    SELECT canal, count(*) AS total_fraudes,
           {pct('count(*)', '(SELECT count(*) FROM alertas)')} AS porcentaje
    FROM alertas GROUP BY 1""")
BY_MONTH = alerts("""
    SELECT strftime(fecha, '%Y-%m') AS anio_mes, count(*) AS total_fraudes,
           CAST(sum(monto) AS DOUBLE) AS monto_total
    FROM alertas GROUP BY 1""")


def flag(name: str) -> str:
    return query(
        [*bank("transacciones", "clientes", "datos_personales", timed=True), ("puntuadas", SCORED)],
        f"SELECT id_transaccion, {name} FROM puntuadas",
    )


def page_facts(source_ctes, source: str, page: int, limit: int) -> str:
    return query(source_ctes, f"""
        SELECT count(*) AS total, {page} AS page, {limit} AS "limit",
               CAST(ceil(count(*) / {limit}.0) AS BIGINT) AS "totalPages"
        FROM ({source})""")


FRAUD = {
    "fraud_r1_geo": flag("r1_geo"),
    "fraud_r2_velocity": flag("r2_velocidad"),
    "fraud_r3_amount": flag("r3_monto"),
    "fraud_r4_hour": flag("r4_hora"),
    "fraud_alerts": alerts(f"SELECT {ALERT_COLUMNS} FROM alertas"),
    "fraud_by_category": BY_CATEGORY,
    "fraud_by_channel": BY_CHANNEL,
    "fraud_by_month": BY_MONTH,
    "fraud_summary": SUMMARY,
    "etl_run": SUMMARY,
    "etl_tipo_cambio_csv": query(bank("tipo_cambio"), "SELECT fecha, rate FROM tipo_cambio"),
    "etl_resumen": SUMMARY,
    "etl_otra_sesion": "\nUNION ALL\n".join(
        f"SELECT '{name}' AS tabla, count(*) AS filas FROM ({sql})"
        for name, sql in {
            "resumen_general": SUMMARY, "fraude_por_categoria": BY_CATEGORY,
            "fraude_por_canal": BY_CHANNEL, "fraude_por_mes": BY_MONTH,
            "alertas_fraude": alerts("SELECT * FROM alertas"),
        }.items()
    ),
    "etl_fraude_por_categoria": BY_CATEGORY,
    "etl_fraude_por_canal": BY_CHANNEL,
    "etl_fraude_por_mes": BY_MONTH,
    "etl_fraude_geografico": query(bank("transacciones"), """
        SELECT CAST(round(latitud, 1) AS DOUBLE) AS lat, CAST(round(longitud, 1) AS DOUBLE) AS lng,
               count(*) AS total_fraudes, CAST(sum(monto) AS DOUBLE) AS monto_total,
               CAST(sum(monto) AS DOUBLE) / count(monto) AS monto_promedio,
               mode() WITHIN GROUP (ORDER BY categoria) AS categoria_top,
               mode() WITHIN GROUP (ORDER BY canal) AS canal_top
        FROM transacciones
        WHERE es_fraude_potencial AND latitud IS NOT NULL AND longitud IS NOT NULL
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 200"""),
    "etl_fraude_por_comercio": query(bank("transacciones"), """
        SELECT comercio, categoria, count(*) AS total_fraudes, CAST(sum(monto) AS DOUBLE) AS monto_total,
               CAST(sum(monto) AS DOUBLE) / count(monto) AS monto_promedio,
               count(DISTINCT id_cliente) AS clientes_afectados, max(fecha) AS ultima_alerta
        FROM transacciones WHERE es_fraude_potencial AND comercio IS NOT NULL
        GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 NULLS LAST LIMIT 20"""),
    "etl_alertas_fraude": alerts(
        f"SELECT {ALERT_COLUMNS} FROM alertas ORDER BY fecha DESC, id_transaccion LIMIT 25 OFFSET 25"),
    "etl_alertas_fraude_info": alerts("""
        SELECT count(*) AS total, 2 AS page, 25 AS "limit",
               CAST(ceil(count(*) / 25.0) AS BIGINT) AS "totalPages" FROM alertas"""),
    "etl_alertas_fraude_after": alerts(f"""
        SELECT {ALERT_COLUMNS} FROM alertas
        WHERE fecha < TIMESTAMP '2024-01-20' OR (fecha = TIMESTAMP '2024-01-20' AND id_transaccion > 'E5')
        ORDER BY fecha DESC, id_transaccion LIMIT 25"""),
    "etl_resumen_periodo": query(bank("transacciones"), f"""
        SELECT count(*) FILTER (WHERE es_fraude_potencial) AS total_fraudes,
               CAST(sum(monto) FILTER (WHERE es_fraude_potencial) AS DOUBLE) AS monto_total,
               {pct('count(*) FILTER (WHERE es_fraude_potencial)', 'count(*)')} AS tasa_fraude
        FROM transacciones WHERE {within('fecha')}"""),
}

# ── lookups ─────────────────────────────────────────────────────────────────────────────

OVERDUE = "SELECT id_cliente FROM prestamos WHERE estatus_prestamo = 'Vencido'"

CLIENTS_KEPT = """
    SELECT c.* FROM clientes c JOIN open_data o USING (id_cliente)
    WHERE (c.nombre ILIKE '%ez%' OR c.apellido_paterno ILIKE '%ez%')
      AND o.segmento_cliente = 'BUILDING' AND o.nivel_riesgo = 'Medio'"""

TX_KEPT = """
    SELECT * FROM transacciones
    WHERE CAST(fecha AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1999-12-31'
      AND canal = 'Web' AND es_fraude_potencial AND tipo = 'Retiro'"""


def children(table: str) -> str:
    return query(bank(table, "clientes"),
                 f"SELECT * FROM {table} WHERE id_cliente IN (SELECT id_cliente FROM clientes)")


LOOKUPS = {
    "clientes_list": query(bank("clientes", "open_data", "datos_personales"), f"""
        SELECT k.*, o.segmento_cliente, o.nivel_riesgo, o.score_crediticio, d.email, d.ciudad, d.estado
        FROM ({CLIENTS_KEPT} ORDER BY c.apellido_paterno, c.id_cliente LIMIT 5 OFFSET 5) k
        LEFT JOIN open_data o USING (id_cliente) LEFT JOIN datos_personales d USING (id_cliente)"""),
    "clientes_list_info": page_facts(bank("clientes", "open_data"), CLIENTS_KEPT, 2, 5),
    "cliente_perfil": query(bank("clientes", "datos_personales", "datos_negocio", "open_data"), """
        SELECT c.*, p.email, p.ciudad, p.estado, n.giro_negocio, n.num_empleados, n.paga_nomina,
               o.segmento_cliente, o.nivel_riesgo, o.score_crediticio,
               n.id_cliente IS NOT NULL AS tiene_negocio
        FROM clientes c LEFT JOIN datos_personales p ON p.id_cliente = c.id_cliente
        LEFT JOIN datos_negocio n ON n.id_cliente = c.id_cliente
        LEFT JOIN open_data o ON o.id_cliente = c.id_cliente"""),
    "cliente_cuentas": children("cuentas"),
    "cliente_transacciones": query(bank("transacciones", "clientes", timed=True), """
        SELECT t.* EXCLUDE (n) FROM (
            SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY fecha DESC, id_transaccion) AS n
            FROM transacciones) t
        WHERE n <= 50 AND id_cliente IN (SELECT id_cliente FROM clientes)"""),
    "cliente_prestamos": children("prestamos"),
    "cliente_tarjetas": children("tarjetas"),
    "cliente_metas": children("metas_ahorro"),
    "transacciones_list": query(bank("transacciones", "clientes"), f"""
        SELECT k.*, c.nombre, c.apellido_paterno
        FROM ({TX_KEPT} ORDER BY fecha DESC, id_transaccion LIMIT 50 OFFSET 50) k
        JOIN clientes c USING (id_cliente)"""),
    "transacciones_list_info": page_facts(bank("transacciones"), TX_KEPT, 2, 50),
    "transaccion_detalle": query(bank("transacciones", "clientes", timed=True), """
        SELECT t.*, c.nombre, c.apellido_paterno FROM transacciones t JOIN clientes c USING (id_cliente)"""),
    "clientes_list_after": query(bank("clientes", "open_data", "datos_personales"), f"""
        SELECT k.*, o.segmento_cliente, o.nivel_riesgo, o.score_crediticio, d.email, d.ciudad, d.estado
        FROM (SELECT * FROM ({CLIENTS_KEPT}) c
              WHERE apellido_paterno > 'Martínez' OR (apellido_paterno = 'Martínez' AND id_cliente > 'C4')
              ORDER BY apellido_paterno, id_cliente LIMIT 5) k
        LEFT JOIN open_data o USING (id_cliente) LEFT JOIN datos_personales d USING (id_cliente)"""),
    "transacciones_list_after": query(bank("transacciones", "clientes"), f"""
        SELECT k.*, c.nombre, c.apellido_paterno
        FROM (SELECT * FROM ({TX_KEPT})
              WHERE fecha < TIMESTAMP '1998-03-01' OR (fecha = TIMESTAMP '1998-03-01' AND id_transaccion > 'L2')
              ORDER BY fecha DESC, id_transaccion LIMIT 50) k
        JOIN clientes c USING (id_cliente)"""),
    "clientes_list_guardada": query(bank("clientes", "open_data", "datos_personales"), """
        SELECT k.*, o.segmento_cliente, o.nivel_riesgo, o.score_crediticio, d.email, d.ciudad, d.estado
        FROM (SELECT * FROM clientes ORDER BY apellido_paterno, id_cliente LIMIT 20 OFFSET 60) k
        LEFT JOIN open_data o USING (id_cliente) LEFT JOIN datos_personales d USING (id_cliente)"""),
    "transacciones_list_guardada": query(bank("transacciones", "clientes"), """
        SELECT k.*, c.nombre, c.apellido_paterno
        FROM (SELECT * FROM transacciones ORDER BY fecha DESC, id_transaccion LIMIT 50 OFFSET 1800) k
        JOIN clientes c USING (id_cliente)"""),
    "transacciones_list_guardada_info": page_facts(
        bank("transacciones"), "SELECT * FROM transacciones", 37, 50
    ),
    "cliente_transacciones_por_id": query(bank("transacciones", "clientes"), """
        SELECT t.* EXCLUDE (n) FROM (
            SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY fecha DESC, id_transaccion) AS n
            FROM transacciones) t
        WHERE n <= 20 AND id_cliente IN ('C7', 'C12') AND id_cliente IN (SELECT id_cliente FROM clientes)"""),
    "cliente_perfil_por_id": query(bank("clientes", "datos_personales", "datos_negocio", "open_data"), """
        SELECT c.*, p.email, p.ciudad, p.estado, n.giro_negocio, n.num_empleados, n.paga_nomina,
               o.segmento_cliente, o.nivel_riesgo, o.score_crediticio,
               n.id_cliente IS NOT NULL AS tiene_negocio
        FROM clientes c LEFT JOIN datos_personales p ON p.id_cliente = c.id_cliente
        LEFT JOIN datos_negocio n ON n.id_cliente = c.id_cliente
        LEFT JOIN open_data o ON o.id_cliente = c.id_cliente
        WHERE c.id_cliente = 'C12'"""),
    "cliente_cuentas_por_id": query(bank("cuentas", "clientes"), """
        SELECT a.* FROM cuentas a WHERE id_cliente IN ('C7', 'C12')
          AND EXISTS (SELECT 1 FROM clientes c WHERE c.id_cliente = a.id_cliente)"""),
    "transaccion_detalle_por_id": query(bank("transacciones", "clientes", timed=True), """
        SELECT t.*, c.nombre, c.apellido_paterno FROM transacciones t JOIN clientes c USING (id_cliente)
        WHERE id_transaccion IN ('E3', 'E86')"""),
    "cliente_cuentas_de_varios": query(bank("cuentas", "clientes", "prestamos"), f"""
        SELECT a.* FROM cuentas a WHERE id_cliente IN ({OVERDUE})
          AND EXISTS (SELECT 1 FROM clientes c WHERE c.id_cliente = a.id_cliente)"""),
    "cliente_transacciones_de_varios": query(bank("transacciones", "clientes", "prestamos", timed=True), f"""
        SELECT t.* EXCLUDE (n) FROM (
            SELECT *, row_number() OVER (PARTITION BY id_cliente ORDER BY fecha DESC, id_transaccion) AS n
            FROM transacciones) t
        WHERE n <= 20 AND id_cliente IN (SELECT id_cliente FROM clientes) AND id_cliente IN ({OVERDUE})"""),
}

# ── history ─────────────────────────────────────────────────────────────────────────────


def per_year(table: str, on: str, columns: str, years=YEARS, part: str = "") -> str:
    extra = f", CAST(extract({part.split()[0]} FROM {on}) AS INTEGER) AS {part.split()[1]}" if part else ""
    groups = "1, 2" if part else "1"
    return query(bank(table), f"""
        SELECT CAST(extract(year FROM {on}) AS INTEGER) AS anio{extra}, {columns}
        FROM {table} WHERE extract(year FROM {on}) IN ({', '.join(map(str, years))})
        GROUP BY {groups}""")


FRAUDS = "count(*) FILTER (WHERE es_fraude_potencial) AS fraudes"
METRICS = (
    ("cuentas_nuevas", "cuentas", "fecha_apertura", "true"),
    ("transacciones", "transacciones", "fecha", "true"),
    ("fraudes", "transacciones", "fecha", "es_fraude_potencial"),
    ("prestamos", "prestamos", "fecha_otorgamiento", "true"),
    ("pagos", "pagos", "fecha_pago", "true"),
    ("seguros", "seguros", "fecha_inicio", "true"),
    ("metas_completadas", "metas_ahorro", "fecha_inicio", "lower(estatus) LIKE '%complet%'"),
    ("cobros_excedidos", "cobros", "fecha_cobro", "excede_limite"),
)
YEARLY = " UNION ALL ".join(
    f"""SELECT '{name}' AS metrica, {year} AS anio,
               (SELECT count(*) FROM {table} WHERE extract(year FROM {on}) = {year} AND {keep}) AS valor"""
    for name, table, on, keep in METRICS for year in YEARS
)
YEARLY_TABLES = ("cuentas", "transacciones", "prestamos", "pagos", "seguros", "metas_ahorro", "cobros")


def tenths(now: str, before: str) -> str:
    """|change| in tenths of a percent, rounded half-up."""
    return (f"CAST((2000 * abs(CAST({now} AS HUGEINT) - {before}) + {before}) "
            f"// (2 * CAST({before} AS HUGEINT)) AS BIGINT)")


def hundredths(value: str, unit) -> str:
    """value / unit with two decimals as text, rounded half-up (integers, non-negative)."""
    rounded = f"((200 * {value} + {unit}) // (2 * {unit}))"
    return (f"CAST({rounded} // 100 AS VARCHAR) || '.' || lpad(CAST({rounded} % 100 AS VARCHAR), 2, '0')")


def change(now: str, before: str) -> str:
    shown = f"CAST({tenths(now, before)} // 10 AS VARCHAR) || '.' || CAST({tenths(now, before)} % 10 AS VARCHAR) || '%'"
    return (f"CASE WHEN {before} = 0 AND {now} > 0 THEN 'aumentó 100%' WHEN {before} = 0 THEN 'sin cambio' "
            f"WHEN {now} >= {before} THEN 'aumentó ' || {shown} ELSE 'bajó ' || {shown} END")


def two_years(table: str, on: str, now: int, before: int, part: str, unit: str, size: int,
              metrics: dict[str, str], label: str) -> str:
    counts, shown = [], []
    for name, keep in metrics.items():
        counts += [
            f"(SELECT count(*) FROM {table} WHERE extract(year FROM {on}) = {year} "
            f"AND extract({unit} FROM {on}) = g.n AND {keep}) AS {name}_{tag}"
            for year, tag in ((now, "actual"), (before, "previo"))
        ]
        shown.append(f"{change(f'{name}_actual', f'{name}_previo')} AS {name}_cambio")
    return query(bank(table), f"""
        SELECT *, {', '.join(shown)} FROM (
            SELECT CAST(g.n AS INTEGER) AS {part}, {', '.join(counts)}, {label}
            FROM generate_series(1, {size}) AS g(n))""")


QUARTER_NAME = f"{list(text.TRIMESTRES)}[g.n] AS trimestre"
MONTH_NAME = f"{list(text.MESES)}[g.n] AS nombre_mes"
TX_METRICS = {"tx": "true", "fraudes": "es_fraude_potencial"}

HISTORY = {
    "ctx_snapshot": query(
        bank("clientes", "cuentas", "prestamos", "transacciones", "cobros", "tarjetas", "seguros",
             "metas_ahorro"),
        f"""SELECT r.* EXCLUDE (transaccionesHoy),
                   (SELECT count(*) FROM tarjetas WHERE estatus_tarjeta = 'Activa') AS tarjetasActivas,
                   (SELECT count(*) FROM seguros WHERE estatus_seguro = 'Activo') AS segurosActivos,
                   (SELECT count(*) FROM metas_ahorro WHERE estatus IN ('Activa', 'En progreso')) AS metasActivas
            FROM ({RESUMEN}) r"""),
    "ctx_tx_anual": per_year("transacciones", "fecha", f"""count(*) AS tx,
        CAST(round(sum(monto), 0) AS DOUBLE) AS monto, {FRAUDS},
        {pct('count(*) FILTER (WHERE es_fraude_potencial)', 'count(*)')} AS tasa"""),
    "ctx_tx_anual_texto": query(
        [*bank("transacciones"), ("anual", f"""
            SELECT CAST(extract(year FROM fecha) AS INTEGER) AS anio, count(*) AS n,
                   CAST(round(sum(monto), 0) AS HUGEINT) AS m,
                   count(*) FILTER (WHERE es_fraude_potencial) AS f
            FROM transacciones WHERE extract(year FROM fecha) IN (1996, 1997, 1998) GROUP BY 1""")],
        f"""SELECT anio, format('{{:,}}', n) AS tx, format('{{:,}}', f) AS fraudes,
               CASE WHEN m >= 1000000000 THEN '$' || {hundredths('m', 10**9)} || 'B MXN'
                    WHEN m >= 1000000 THEN '$' || {hundredths('m', 10**6)} || 'M MXN' END AS monto,
               {hundredths('100 * CAST(f AS HUGEINT)', 'n')} || '%' AS tasa
            FROM anual"""),
    "ctx_cuentas_anual": per_year("cuentas", "fecha_apertura", "count(*) AS nuevas"),
    "ctx_pagos_anual": per_year("pagos", "fecha_pago", """count(*) AS total,
        CAST(round(sum(monto_pago), 0) AS DOUBLE) AS monto,
        count(*) FILTER (WHERE lower(estatus_pago) LIKE '%exit%') AS exitosos"""),
    "ctx_prestamos_anual": per_year("prestamos", "fecha_otorgamiento", """count(*) AS total,
        CAST(round(sum(monto_prestamo), 0) AS DOUBLE) AS monto,
        count(*) FILTER (WHERE estatus_prestamo = 'Vencido') AS vencidos"""),
    "ctx_seguros_anual": per_year("seguros", "fecha_inicio", "count(*) AS total"),
    "ctx_metas_anual": per_year("metas_ahorro", "fecha_inicio", """count(*) AS total,
        count(*) FILTER (WHERE lower(estatus) LIKE '%complet%') AS completadas,
        count(*) FILTER (WHERE lower(estatus) LIKE '%fall%') AS fallidas"""),
    "ctx_cobros_anual": per_year("cobros", "fecha_cobro", """count(*) AS total,
        count(*) FILTER (WHERE excede_limite) AS excedidos"""),
    "ctx_tx_trimestral": per_year(
        "transacciones", "fecha", f"count(*) AS tx, {FRAUDS}", YEARS[1:], "quarter q"),
    "ctx_cuentas_trimestral": per_year(
        "cuentas", "fecha_apertura", "count(*) AS nuevas", YEARS[:2], "quarter q"),
    "ctx_tx_mensual": per_year(
        "transacciones", "fecha", f"count(*) AS tx, {FRAUDS}", YEARS[1:], "month mes"),
    "ctx_prestamos_por_tipo": query(bank("prestamos"), f"""
        SELECT tipo_prestamo AS tipo, count(*) AS total,
               CAST(round(sum(saldo_prestamo), 0) AS DOUBLE) AS saldo,
               {half_up(cents('sum(tasa_prestamo)'), '100 * count(tasa_prestamo)')} AS tasa,
               count(*) FILTER (WHERE estatus_prestamo = 'Vencido') AS vencidos
        FROM prestamos WHERE tipo_prestamo IS NOT NULL GROUP BY 1"""),
    "ctx_top5_sucursales": query(bank("cuentas"), """
        SELECT sucursal, count(*) AS cuentas FROM cuentas WHERE sucursal IS NOT NULL
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
    "ctx_scores": query(bank("open_data"), score_ranges(history.SCORE_LABELS_CORTAS)),
    "ctx_variacion_anual": query([*bank(*YEARLY_TABLES), ("anual", YEARLY)], f"""
        SELECT a.metrica, a.anio, a.valor, b.valor AS previo,
               CASE WHEN b.valor = 0 THEN NULL
                    ELSE sign(a.valor - b.valor) * {tenths('a.valor', 'b.valor')} / 10 END AS cambio_pct,
               {change('a.valor', 'b.valor')} AS texto
        FROM anual a JOIN anual b ON b.metrica = a.metrica AND b.anio = a.anio - 1"""),
    "ctx_anio_maximo": query([*bank(*YEARLY_TABLES), ("anual", YEARLY)], """
        SELECT metrica, min(anio) AS anio, valor FROM anual a
        WHERE valor = (SELECT max(valor) FROM anual b WHERE b.metrica = a.metrica)
        GROUP BY metrica, valor"""),
    "ctx_comparativa_trimestral": two_years(
        "transacciones", "fecha", 1998, 1997, "q", "quarter", 4, TX_METRICS, QUARTER_NAME),
    "ctx_comparativa_trimestral_cuentas": two_years(
        "cuentas", "fecha_apertura", 2001, 2000, "q", "quarter", 4, {"nuevas": "true"}, QUARTER_NAME),
    "ctx_comparativa_mensual": two_years(
        "transacciones", "fecha", 1998, 1997, "mes", "month", 12, TX_METRICS, MONTH_NAME),
    "ctx_indicadores": query(risks(), " UNION ALL ".join(
        f"""SELECT '{label}' AS indicador, {column} AS valor, {LIMITS[column]} AS umbral,
                   CASE WHEN {column} > {LIMITS[column]} THEN '{history.EN_RIESGO}' ELSE '{history.DENTRO_DEL_LIMITE}' END AS estado
            FROM debilidades""" for label, column, _ in kpis.ETIQUETAS_RIESGO)),
    "ctx_utilizacion": utilization("util", "tarjetas", "saldo", "limite"),
    "ctx_morosidad": delinquency("activas", "morosas", "tasa"),
    "ctx_pagos_por_estatus": share("pagos", "estatus_pago", "est", "pct"),
    "ctx_pagos_por_canal": share("pagos", "canal_pago", "canal", "pct"),
    "ctx_seguros_por_estatus": share("seguros", "estatus_seguro", "est", "pct"),
    "ctx_prima_anual": premium("promedio", "total", "polizas"),
    "ctx_notificaciones_por_canal": share("notificaciones", "canal_notificacion", "canal", "pct"),
    "ctx_metas_por_estatus": share("metas_ahorro", "estatus", "estatus", "pct"),
    "ctx_metas_progreso": goals("progreso", "activas", "objetivo", "actual"),
    "ctx_nomina": query(bank("datos_negocio"), f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE paga_nomina = true) AS con_nomina,
               {pct('count(*) FILTER (WHERE paga_nomina = true)', 'count(*)')} AS pct
        FROM datos_negocio"""),
    "ctx_segmentos": query(bank("open_data"), """
        SELECT segmento_cliente AS seg, count(*) AS total FROM open_data
        WHERE segmento_cliente IS NOT NULL GROUP BY 1"""),
}

# ── report ──────────────────────────────────────────────────────────────────────────────

FRAUD_LEVEL = f"""
    SELECT porcentajeFraudePotencial,
           (SELECT count(*) FROM transacciones WHERE es_fraude_potencial) AS fraudesPotenciales,
           CASE WHEN porcentajeFraudePotencial > 5 THEN 'ALTO' WHEN porcentajeFraudePotencial > 2 THEN 'MEDIO'
                ELSE 'BAJO' END AS nivel,
           CASE WHEN porcentajeFraudePotencial > 5 THEN '{report.MENSAJE_ALTO}'
                WHEN porcentajeFraudePotencial > 2 THEN '{report.MENSAJE_MEDIO}'
                ELSE '{report.MENSAJE_BAJO}' END AS mensaje
    FROM debilidades"""

LIGHTS = " UNION ALL ".join(
    f"""SELECT '{label}' AS indicador, {number_text(column)} || '%' AS valor, {column} > {LIMITS[column]} AS riesgo,
               CASE WHEN {column} > {LIMITS[column]} THEN '{report.SOBRE_UMBRAL}' ELSE '{report.BAJO_UMBRAL}' END AS etiqueta
        FROM debilidades""" for label, column, _ in kpis.ETIQUETAS_RIESGO)


def chart(name: str, source: str, label: str, order: str, top: bool = True) -> str:
    limit = "LIMIT 10" if top else ""
    return f"""SELECT '{name}' AS grafica, etiqueta, valor FROM (
        SELECT {label} AS etiqueta, total AS valor FROM ({source}) ORDER BY {order} {limit})"""


SEGMENTS = "SELECT segmento_cliente AS s, count(*) AS total FROM open_data WHERE segmento_cliente IS NOT NULL GROUP BY 1"
BARS = " UNION ALL ".join((
    chart("Transacciones por Mes (últimos 12 meses)", TENDENCIA, "mes[6:7]", "mes", False),
    chart("Clientes por Segmento", SEGMENTS, "s", "total DESC, s"),
    chart("Transacciones por Canal",
          "SELECT canal, count(*) AS total FROM transacciones WHERE canal IS NOT NULL GROUP BY 1",
          "canal", "total DESC, canal"),
    chart("Distribución de Score Crediticio", score_ranges(kpis.SCORE_LABELS), "rango", "rango"),
    chart("Préstamos por Tipo",
          """SELECT tipo_prestamo, count(*) AS total, sum(saldo_prestamo) AS s FROM prestamos
             WHERE tipo_prestamo IS NOT NULL GROUP BY 1""", "tipo_prestamo", "s DESC, tipo_prestamo"),
    chart("Cobros Excedidos por Tipo de Comisión",
          """SELECT tipo_comision, count(*) AS total, sum(diferencia) AS d FROM auditoria_comisiones
             WHERE resultado = 'Excede' GROUP BY 1""", "tipo_comision", "d DESC, tipo_comision"),
))
SERIES = f"""SELECT *, CAST(valor AS DOUBLE) / greatest(max(valor) OVER (PARTITION BY grafica), 1) AS fraccion
             FROM ({BARS})"""
SERIES_TABLES = ("transacciones", "open_data", "prestamos", "auditoria_comisiones")


def grouped(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def grouped_money(value: str) -> str:
    return (f"'$' || format('{{:,}}', CAST({cents(value)} // 100 AS BIGINT)) || '.' "
            f"|| lpad(CAST({cents(value)} % 100 AS VARCHAR), 2, '0')")


CARDS = " UNION ALL ".join(
    f"SELECT '{label}' AS tarjeta, {show} AS valor FROM resumen"
    for label, show in (
        ("Total Clientes", grouped("totalClientes")),
        ("Cuentas Activas", grouped("cuentasActivas")),
        ("Saldo Total", grouped_money("CAST(saldoTotalCuentas AS DECIMAL(30,2))")),
        ("Préstamos Vigentes", grouped("prestamosActivos")),
        ("Fraudes Potenciales", grouped("fraudesPotenciales")),
        ("Cobros Excedidos", grouped("cobrosExcedidos")),
    ))
REPORT_TABLES = ("clientes", "cuentas", "prestamos", "transacciones", "cobros", "metas_ahorro", "open_data",
                 "auditoria_comisiones")

REPORT = {
    "rep_nivel_fraude": query(risks(), FRAUD_LEVEL),
    "rep_semaforo": query(risks(), LIGHTS),
    "rep_series": query(bank(*SERIES_TABLES), SERIES),
    "rep_tarjetas": query(
        [*bank("clientes", "cuentas", "prestamos", "transacciones", "cobros"), ("resumen", RESUMEN)], CARDS),
    "rep_reporte": query(
        [*bank(*REPORT_TABLES), ("resumen", RESUMEN), ("debilidades", DEBILIDADES), ("series", SERIES),
         ("soluciones", SOLUCIONES)],
        f"""SELECT 'kpis' AS seccion, 'Resumen General' AS bloque, tarjeta AS etiqueta, valor AS texto FROM ({CARDS})
            UNION ALL SELECT 'kpis', 'Clientes por Segmento', s, {grouped('total')} FROM ({SEGMENTS})
            UNION ALL SELECT 'kpis', 'Tendencia de Transacciones (últimos 12 meses)', mes,
                {grouped('total')} || ' · ' || coalesce({grouped_money('CAST(monto_total AS DECIMAL(30,2))')}, '$0.00')
                FROM ({TENDENCIA})
            UNION ALL SELECT 'fraude', 'Análisis de Fraude Potencial', nivel, mensaje FROM ({FRAUD_LEVEL})
            UNION ALL SELECT 'graficas', grafica, etiqueta, {grouped('valor')} FROM series
            UNION ALL SELECT 'debilidades', 'Indicadores de Riesgo', indicador, valor FROM ({LIGHTS})
            UNION ALL SELECT 'recomendaciones', 'Soluciones Recomendadas', area, solucion FROM soluciones
            UNION ALL SELECT 'recomendaciones', 'Soluciones Recomendadas', NULL,
                '{report.SIN_SOLUCIONES}'
                WHERE NOT EXISTS (SELECT 1 FROM soluciones)"""),
}

# ── streams: a replay gives what the batch jobs give over all events ────────────────────

STREAMS = {
    "stream_totales_por_canal": query(bank("transacciones", timed=True), """
        SELECT date_trunc('hour', fecha) AS desde, date_trunc('hour', fecha) + INTERVAL 1 HOUR AS hasta,
               canal, count(*) AS total, CAST(sum(monto) AS DOUBLE) AS monto_total,
               count(*) FILTER (WHERE es_fraude_potencial) AS fraudes
        FROM transacciones GROUP BY 1, 2, 3"""),
    "stream_velocidad_deslizante": query(bank("transacciones", timed=True), """
        SELECT desde, desde + INTERVAL 1 HOUR AS hasta, id_cliente, count(*) AS total
        FROM (SELECT id_cliente,
                     unnest([time_bucket(INTERVAL 5 MINUTE, fecha) - INTERVAL 5 MINUTE * k
                             for k in range(12)]) AS desde
              FROM transacciones)
        GROUP BY 1, 2, 3 HAVING count(*) > 3"""),
    "stream_velocidad_exacta": query(
        [*bank("transacciones", "clientes", "datos_personales", timed=True), ("puntuadas", SCORED)],
        "SELECT DISTINCT id_cliente, fecha FROM puntuadas WHERE r2_velocidad"),
    "stream_reglas_sin_estado": query(
        [*bank("transacciones", "clientes", "datos_personales", timed=True), ("puntuadas", SCORED)],
        "SELECT id_transaccion, id_cliente, fecha, r1_geo, r4_hora FROM puntuadas"),
}


# Plans over the stored daily aggregate give what they give over the transactions.
OF_DAYS = (
    "kpi_transacciones_por_categoria", "kpi_transacciones_por_canal", "kpi_tendencia", "kpi_canal_periodo",
    "ctx_tx_anual", "ctx_tx_trimestral", "ctx_tx_mensual", "rep_series", "rep_reporte",
)


def all_checks() -> dict[str, str]:
    checks = {**KPIS, **FRAUD, **LOOKUPS, **HISTORY, **REPORT, **STREAMS}
    return checks | {f"{name}_diario": checks[name] for name in OF_DAYS}
