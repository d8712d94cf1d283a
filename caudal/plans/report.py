"""Tidy tables behind the executive report (M1-M5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caudal.functions.dates import month_label
from caudal.functions.numbers import as_double, pct_of_counts, scaled_to
from caudal.functions.text import money, month_of_label, plain_number, thousands
from caudal.operators.grouping import unpivot_row
from caudal.plans import kpis
from caudal.plans.daily import is_later_day, rest_of_day
from caudal.sources.tables import Tables

# Levels, labels and messages the report must carry.
NIVEL_ALTO, NIVEL_MEDIO, NIVEL_BAJO = "ALTO", "MEDIO", "BAJO"
FRAUDE_ALTO, FRAUDE_MEDIO = 5, 2
MENSAJE_ALTO = (
    "Se recomienda activar protocolos de emergencia antifraude y revisar las reglas del motor "
    "de detección de manera inmediata."
)
MENSAJE_MEDIO = (
    "Monitorear de cerca las transacciones sospechosas y reforzar los controles de autenticación."
)
MENSAJE_BAJO = (
    "Los niveles de fraude están dentro de parámetros normales. Mantener monitoreo rutinario."
)
SOBRE_UMBRAL, BAJO_UMBRAL = "⚠ Por encima del umbral", "✓ Dentro del umbral"
SIN_SOLUCIONES = "No se detectaron áreas de mejora urgentes en este período."
TARJETAS = (
    ("Total Clientes", "totalClientes", thousands),
    ("Cuentas Activas", "cuentasActivas", thousands),
    ("Saldo Total", "saldoTotalCuentas", money),
    ("Préstamos Vigentes", "prestamosActivos", thousands),
    ("Fraudes Potenciales", "fraudesPotenciales", thousands),
    ("Cobros Excedidos", "cobrosExcedidos", thousands),
)
BARRAS_MAXIMAS = 10
CHARTS = (
    "Transacciones por Mes (últimos 12 meses)", "Clientes por Segmento", "Transacciones por Canal",
    "Distribución de Score Crediticio", "Préstamos por Tipo",
    "Cobros Excedidos por Tipo de Comisión",
)


def fraud_level() -> Column:
    pct = F.col("porcentajeFraudePotencial")
    return (
        F.when(pct > FRAUDE_ALTO, NIVEL_ALTO).when(pct > FRAUDE_MEDIO, NIVEL_MEDIO)
        .otherwise(NIVEL_BAJO)
    )


def fraud_message() -> Column:
    level = fraud_level()
    return (
        F.when(level == NIVEL_ALTO, MENSAJE_ALTO).when(level == NIVEL_MEDIO, MENSAJE_MEDIO)
        .otherwise(MENSAJE_BAJO)
    )


def rep_nivel_fraude(t: Tables) -> DataFrame:
    """Fraud percentage, number of cases, risk level and advice."""
    cases = F.count_if("es_fraude_potencial")
    rate = F.coalesce(pct_of_counts(cases, F.count("*")), F.lit(0.0))
    return t.transacciones.agg(
        rate.alias("porcentajeFraudePotencial"), cases.alias("fraudesPotenciales")
    ).select("*", fraud_level().alias("nivel"), fraud_message().alias("mensaje"))


def rep_semaforo(t: Tables) -> DataFrame:
    """The five risk indicators with value text, flag and label."""
    entries = [
        {
            "indicador": F.lit(label),
            "valor": F.concat(plain_number(F.col(column)), F.lit("%")),
            "riesgo": F.col(column) > threshold,
            "etiqueta": F.when(F.col(column) > threshold, SOBRE_UMBRAL).otherwise(BAJO_UMBRAL),
        }
        for label, column, threshold in kpis.ETIQUETAS_RIESGO
    ]
    return unpivot_row(kpis.kpi_debilidades(t), entries)


def _bars(chart: str, frame: DataFrame, label: str | Column, items: int | None) -> DataFrame:
    bars = frame if items is None else frame.limit(items)
    label = F.col(label) if isinstance(label, str) else label
    return bars.select(
        F.lit(chart).alias("grafica"), label.alias("etiqueta"), F.col("total").alias("valor")
    )


def _other_charts(t: Tables) -> list[DataFrame]:
    """The charts that are neither of transactions nor of segments."""
    top = BARRAS_MAXIMAS
    return [
        _bars(CHARTS[3], kpis.kpi_score_crediticio(t), "rango", top),
        _bars(CHARTS[4], kpis.kpi_prestamos_por_tipo(t), "tipo", top),
        _bars(CHARTS[5], kpis.kpi_cobros_excedidos(t), "tipo", top),
    ]


def _segments(t: Tables, listed: bool, drawn: bool) -> DataFrame:
    """Clients per segment as rows of the report's table, its chart or both, counted once."""
    place = F.row_number().over(Window.orderBy(F.desc("total"), "segmento"))
    ranked = kpis.kpi_clientes_por_segmento(t).withColumn("lugar", place)
    shown = thousands(F.col("total"))
    both = F.array(
        F.struct(F.lit(listed).alias("va"), _entry("kpis", F.lit(CHARTS[1]), F.col("segmento"), shown).alias("r")),
        F.struct(
            (F.lit(drawn) & (F.col("lugar") <= BARRAS_MAXIMAS)).alias("va"),
            _entry("graficas", F.lit(CHARTS[1]), F.col("segmento"), shown).alias("r"),
        ),
    )
    return ranked.select(F.explode(both).alias("e")).filter("e.va").select("e.r")


def rep_series(
    t: Tables, *, as_of: str | None = None, diario: DataFrame | None = None
) -> DataFrame:
    """The six charts as (grafica, etiqueta, valor, fraccion); the horizontal ones show ten bars.

    ``fraccion`` is the bar's length: its value over the largest of its chart. The transactions'
    charts come from the stored daily aggregate if one is given.
    """
    top = BARRAS_MAXIMAS
    charts = [
        _bars(CHARTS[0], kpis.kpi_tendencia(t, as_of=as_of, diario=diario), month_of_label(F.col("mes")), None),
        _bars(CHARTS[1], kpis.kpi_clientes_por_segmento(t), "segmento", top),
        _bars(CHARTS[2], kpis.kpi_transacciones_por_canal(t, diario=diario), "canal", top),
        *_other_charts(t),
    ]
    # A chart is at most ten bars or thirteen months by now.
    largest = F.max("valor").over(Window.partitionBy("grafica"))
    return reduce(DataFrame.unionByName, charts).withColumn(
        "fraccion", scaled_to(as_double(F.col("valor")), as_double(largest))
    )


def rep_tarjetas(t: Tables) -> DataFrame:
    """Six headline cards with the value as shown."""
    entries = [
        {"tarjeta": F.lit(label), "valor": show(F.col(column))}
        for label, column, show in TARJETAS
    ]
    return unpivot_row(kpis.kpi_resumen(t), entries)


def _advice() -> Column:
    """Array of the recommendations that apply, or the one entry that says there is none."""
    block = F.lit("Soluciones Recomendadas")
    each = F.array(*[
        F.struct(
            (F.col(column) > threshold).alias("sobre"),
            _entry("recomendaciones", block, F.lit(area), F.lit(solution)).alias("fila"),
        )
        for column, threshold, area, _, solution, _ in kpis.INDICADORES
    ])
    found = F.transform(F.filter(each, lambda r: r.getField("sobre")), lambda r: r.getField("fila"))
    none = _entry("recomendaciones", block, F.lit(None).cast("string"), F.lit(SIN_SOLUCIONES))
    return F.when(F.size(found) > 0, found).otherwise(F.array(none))


def _entry(section: str, block: Column, label: Column, text: Column) -> Column:
    return F.struct(
        F.lit(section).alias("seccion"), block.alias("bloque"),
        label.alias("etiqueta"), text.alias("texto"),
    )


def _by_day_and_channel(tx: DataFrame, as_of: str | None) -> DataFrame:
    """(dia, canal, n, fraudes, recientes, monto): the last two of the trend's months alone."""
    recent = F.col("fecha") >= kpis.trend_start(tx, as_of)
    return tx.withColumn("reciente", recent).groupBy(F.to_date("fecha").alias("dia"), "canal").agg(
        F.count("*").alias("n"), F.count_if("es_fraude_potencial").alias("fraudes"),
        F.count_if("reciente").alias("recientes"),
        F.sum(F.when(F.col("reciente"), F.col("monto"))).alias("monto"),
    )


def _from_stored_days(tx: DataFrame, diario: DataFrame, as_of: str | None) -> DataFrame:
    """The same of the stored aggregate; of the transactions only the rest of one day is read."""
    cut = kpis.trend_cut(diario, as_of)
    later = is_later_day(cut)
    whole = diario.select(
        "dia", "canal", "n", "fraudes", F.when(later, F.col("n")).otherwise(0).alias("recientes"),
        F.when(later, F.col("monto")).alias("monto"),
    )
    none = F.lit(0).cast("long")
    first = rest_of_day(tx, cut).select(
        F.to_date("fecha").alias("dia"), "canal", none.alias("n"), none.alias("fraudes"),
        F.lit(1).cast("long").alias("recientes"), "monto",
    )
    sums = [F.sum(c).alias(c) for c in ("n", "fraudes", "recientes", "monto")]
    return whole.unionByName(first).groupBy("dia", "canal").agg(*sums)


def transaction_row(
    t: Tables, as_of: str | None, diario: DataFrame | None = None
) -> DataFrame:
    """One row with all that the report says of the transactions, from one scan of them, or from
    their stored daily aggregate.

    Rows are first added up per day and channel. Each of these counts for its month, its
    channel and its day; months and channels end up as two short lists.
    """
    tx = t.transacciones
    if diario is None:
        daily = _by_day_and_channel(tx, as_of)
    else:
        daily = _from_stored_days(tx, diario, as_of)
    of = lambda kind, key, n: F.struct(
        F.lit(kind).alias("tipo"), key.alias("clave"), F.col(n).alias("n"), "monto", "fraudes"
    )
    kinds = F.array(
        of("mes", month_label(F.col("dia")), "recientes"), of("canal", F.col("canal"), "n"),
        of("dia", F.col("dia").cast("string"), "n"),
    )
    groups = (
        daily.select(F.explode(kinds).alias("g")).groupBy("g.tipo", "g.clave")
        .agg(F.sum("g.n").alias("n"), F.sum("g.monto").alias("monto"), F.sum("g.fraudes").alias("fraudes"))
    )
    here = lambda kind, c: F.when(F.col("tipo") == kind, F.col(c))
    month = F.struct(F.col("clave").alias("mes"), F.col("n").alias("total"), as_double(F.col("monto")).alias("monto_total"))
    channel = F.struct((-F.col("n")).alias("orden"), F.col("clave").alias("canal"), F.col("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return groups.agg(
        F.array_sort(F.collect_list(F.when((F.col("tipo") == "mes") & (F.col("n") > 0), month))).alias("meses"),
        F.array_sort(F.collect_list(
            F.when((F.col("tipo") == "canal") & F.col("clave").isNotNull(), channel)
        )).alias("canales"),
        zero(F.max_by(here("dia", "n"), here("dia", "clave"))).alias("transaccionesHoy"),
        zero(F.sum(here("dia", "fraudes"))).alias("fraudesPotenciales"),
        kpis.fraud_rate(F.sum(here("dia", "fraudes")), F.sum(here("dia", "n"))),
    )


def rep_reporte(
    t: Tables,
    *,
    kpis_on: bool = True,
    fraude: bool = True,
    graficas: bool = True,
    debilidades: bool = True,
    recomendaciones: bool = True,
    as_of: str | None = None,
    diario: DataFrame | None = None,
) -> DataFrame:
    """The chosen sections as (seccion, bloque, etiqueta, texto) rows.

    Everything that hangs on headline numbers, risk percentages and transactions comes from
    one row with all of it. The transactions are scanned once for it, and once more, for their
    latest date alone, unless ``as_of`` is given. With ``diario``, their stored daily aggregate
    (:mod:`caudal.plans.daily`), only one day of them is read.
    """
    from_row: list[Column] = []
    parts: list[DataFrame] = []
    if kpis_on:
        from_row.append(F.array(*[
            _entry("kpis", F.lit("Resumen General"), F.lit(label), show(F.col(column)))
            for label, column, show in TARJETAS
        ]))
        volume = lambda m: F.concat(
            thousands(m["total"]), F.lit(" · "), F.coalesce(money(m["monto_total"]), F.lit("$0.00"))
        )
        trend = F.lit("Tendencia de Transacciones (últimos 12 meses)")
        from_row.append(F.transform("meses", lambda m: _entry("kpis", trend, m["mes"], volume(m))))
    if fraude:
        block = F.lit("Análisis de Fraude Potencial")
        from_row.append(F.array(_entry("fraude", block, fraud_level(), fraud_message())))
    if graficas:
        bar = lambda chart, label, n: _entry("graficas", F.lit(chart), label, thousands(n))
        from_row.append(F.transform(
            "meses", lambda m: bar(CHARTS[0], month_of_label(m["mes"]), m["total"])
        ))
        from_row.append(F.transform(
            F.slice("canales", 1, BARRAS_MAXIMAS), lambda c: bar(CHARTS[2], c["canal"], c["total"])
        ))
        charts = reduce(DataFrame.unionByName, _other_charts(t))
        parts.append(charts.select(_entry(
            "graficas", F.col("grafica"), F.col("etiqueta"), thousands(F.col("valor"))
        ).alias("r")))
    if kpis_on or graficas:
        parts.append(_segments(t, kpis_on, graficas))
    if debilidades:
        from_row.append(F.array(*[
            _entry("debilidades", F.lit("Indicadores de Riesgo"), F.lit(label),
                   F.concat(plain_number(F.col(column)), F.lit("%")))
            for label, column, _ in kpis.ETIQUETAS_RIESGO
        ]))
    if recomendaciones:
        from_row.append(_advice())
    if from_row:
        row = kpis.resumen_y_debilidades(t, transaction_row(t, as_of, diario))
        parts.append(row.select(F.explode(F.concat(*from_row)).alias("r")))
    if not parts:
        raise ValueError("no section chosen")
    return reduce(DataFrame.unionByName, parts).select("r.*")
