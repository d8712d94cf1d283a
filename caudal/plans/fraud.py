"""Fraud scoring (F1-F10): four rules, a score, enriched alerts and the mart built from them."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caudal.functions.dates import month_label
from caudal.functions.geo import haversine_km
from caudal.functions.numbers import as_double, pct_of_counts
from caudal.operators.asof import join_as_of
from caudal.operators.grouping import one_row, with_share
from caudal.operators.rolling import busy_instants
from caudal.operators.spread import plain_side
from caudal.schemas import BANK_TABLES, MART_DDL, mart_schema
from caudal.sources.mart import commit_load, current_load, open_mart
from caudal.sources.sinks import new_load, publish_views, replace_tables
from caudal.sources.tables import Tables, extract


@dataclass(frozen=True)
class FraudRules:
    """Limits and points of the rules (the defaults are fixed values of the method)."""

    max_km: float = 100.0
    max_tx: int = 3
    window_seconds: int = 3600
    max_z: float = 3.0
    from_hour: int = 1
    to_hour: int = 5
    points_geo: int = 3
    points_velocity: int = 2
    points_amount: int = 2
    points_hour: int = 1
    alert_score: int = 3


DEFAULT_RULES = FraudRules()


# ── the rules as columns ────────────────────────────────────────────────────────────────

def is_far(rules: FraudRules) -> Column:
    distance = haversine_km(
        F.col("latitud"), F.col("longitud"),
        F.col("latitud_habitual"), F.col("longitud_habitual"),
    )
    return F.coalesce(distance > rules.max_km, F.lit(False))


def is_outlier(rules: FraudRules) -> Column:
    """One-sided z-score; no deviation (one amount, or all equal) means no flag."""
    z = F.try_divide(as_double(F.col("monto")) - F.col("media"), F.col("desviacion"))
    return F.coalesce(z > rules.max_z, F.lit(False))


def is_odd_hour(rules: FraudRules) -> Column:
    hour = F.hour("fecha")
    return (hour >= rules.from_hour) & (hour < rules.to_hour)


# ── per-client facts ────────────────────────────────────────────────────────────────────

def client_amounts(tx: DataFrame) -> DataFrame:
    """What a transaction adds to its client's amounts. Decimals, so sums are exact whatever
    order they are added in."""
    money = F.col("monto").cast("decimal(18,2)")
    return tx.select(
        "id_cliente", "fecha", F.col("monto").isNotNull().cast("int").alias("n_montos"),
        money.alias("suma"), (money * money).cast("decimal(30,4)").alias("cuadrados"),
    )


def client_instants(tx: DataFrame) -> DataFrame:
    """Rows and amounts of each client and instant, combined map-side.

    Both the velocity rule and the amount profile are answered from this one scan.
    """
    return client_amounts(tx).groupBy("id_cliente", "fecha").agg(
        F.count("*").alias("n"),
        F.sum("n_montos").alias("n_montos"),
        F.sum("suma").alias("suma"),
        F.sum("cuadrados").alias("cuadrados"),
    )


def amount_profile(amounts: DataFrame) -> DataFrame:
    """Mean and sample deviation of the amounts of each client, from :func:`client_amounts`, or
    from :func:`client_instants` where that is stored.

    The sums are exact and turned into doubles once, so a retried task gives the same
    deviation to the last bit.
    """
    n = F.sum("n_montos").cast("double")
    total, squares = as_double(F.sum("suma")), as_double(F.sum("cuadrados"))
    spread = F.greatest(squares - total * total / n, F.lit(0.0))
    return amounts.filter("n_montos > 0").groupBy("id_cliente").agg(
        (total / n).alias("media"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("desviacion"),
    )


def usual_location(t: Tables) -> DataFrame:
    return t.datos_personales.select("id_cliente", "latitud_habitual", "longitud_habitual")


def with_velocity(tx: DataFrame, instants: DataFrame, rules: FraudRules) -> DataFrame:
    """Adds ``r2_velocidad``: too many transactions of the client in the trailing window.

    An outer join on the left: AQE cuts a client and instant with very many transactions, or
    those without a client, into several tasks.
    """
    flagged = busy_instants(
        instants.select("id_cliente", "fecha", "n"), "id_cliente", "fecha",
        more_than=rules.max_tx, within_seconds=rules.window_seconds,
    )
    marked = tx.join(flagged.withColumn("r2_velocidad", F.lit(True)), ["id_cliente", "fecha"], "left")
    return marked.select(*tx.columns, F.coalesce("r2_velocidad", F.lit(False)).alias("r2_velocidad"))


# ── single rules ────────────────────────────────────────────────────────────────────────

def fraud_r1_geo(t: Tables, *, rules: FraudRules = DEFAULT_RULES) -> DataFrame:
    """Transactions with ``r1_geo``: too far from the client's usual place."""
    placed = t.transacciones.join(usual_location(t), "id_cliente", "left")
    flagged = placed.withColumn("r1_geo", is_far(rules))
    return flagged.select(*t.transacciones.columns, "r1_geo")


def fraud_r2_velocity(t: Tables, *, rules: FraudRules = DEFAULT_RULES) -> DataFrame:
    """Transactions with ``r2_velocidad``."""
    tx = t.transacciones
    return with_velocity(tx, client_instants(tx), rules)


def fraud_r3_amount(t: Tables, *, rules: FraudRules = DEFAULT_RULES) -> DataFrame:
    """Transactions with ``r3_monto``: an amount far above the client's mean."""
    tx = t.transacciones
    profile = plain_side(amount_profile(client_amounts(tx)))
    known = tx.join(profile, "id_cliente", "left")
    return known.withColumn("r3_monto", is_outlier(rules)).select(*tx.columns, "r3_monto")


def fraud_r4_hour(t: Tables, *, rules: FraudRules = DEFAULT_RULES) -> DataFrame:
    """Transactions with ``r4_hora``: in the small hours."""
    return t.transacciones.withColumn("r4_hora", is_odd_hour(rules))


# ── score and alerts ────────────────────────────────────────────────────────────────────

def score_transactions(
    t: Tables, *, rules: FraudRules = DEFAULT_RULES, instants: DataFrame | None = None
) -> DataFrame:
    """Every transaction with its four flags, ``score`` and the client's name.

    Everything known about a client (amount profile, name, usual place) is put together
    first, one row per client; the transactions then meet it in one join, and the velocity
    flags in another. ``instants`` is a stored :func:`client_instants`, if there is one; then
    the transactions are read once. The stored fraud flag is not used.
    """
    tx = t.transacciones
    amounts = client_amounts(tx) if instants is None else instants
    instants = client_instants(tx) if instants is None else instants
    names = t.clientes.select(
        "id_cliente", "nombre", "apellido_paterno", F.lit(True).alias("es_cliente")
    )
    client = (
        names.join(amount_profile(amounts), "id_cliente", "full_outer")
        .join(usual_location(t), "id_cliente", "left")
    )
    known = with_velocity(tx, instants, rules).join(plain_side(client), "id_cliente", "left")

    def points(flag: str, n: int) -> Column:
        return F.when(F.col(flag), n).otherwise(0)

    return (
        known.withColumn("r1_geo", is_far(rules))
        .withColumn("r3_monto", is_outlier(rules))
        .withColumn("r4_hora", is_odd_hour(rules))
        .withColumn(
            "score",
            points("r1_geo", rules.points_geo)
            + points("r2_velocidad", rules.points_velocity)
            + points("r3_monto", rules.points_amount)
            + points("r4_hora", rules.points_hour),
        )
        .drop("latitud_habitual", "longitud_habitual", "media", "desviacion")
    )


def flagged_alerts(scored: DataFrame, *, rules: FraudRules = DEFAULT_RULES) -> DataFrame:
    """Scored transactions of known clients at or over the alert score."""
    return scored.filter((F.col("score") >= rules.alert_score) & F.col("es_cliente"))


def with_usd(alerts: DataFrame, t: Tables) -> DataFrame:
    """Adds the day's exchange rate and the amount in USD."""
    quotes = t.tipo_cambio.select(F.col("fecha").alias("dia"), F.col("rate").alias("tipo_cambio"))
    priced = join_as_of(alerts, F.to_date("fecha"), quotes, "dia", "tipo_cambio")
    usd = F.round(F.try_divide(F.col("monto"), F.col("tipo_cambio")), 2)
    return priced.withColumn("monto_usd", usd.cast("decimal(18,2)"))


def with_account(alerts: DataFrame, t: Tables) -> DataFrame:
    """Adds the account's type and branch; NULL for alerts without an account."""
    accounts = t.cuentas.select("num_cuenta", "tipo_cuenta", "sucursal")
    return alerts.join(accounts, "num_cuenta", "left")


def enriched_alerts(alerts: DataFrame, t: Tables) -> DataFrame:
    """Alerts with account and USD amount, as loaded into the mart."""
    return with_usd(with_account(alerts, t), t).select(*mart_schema("alertas_fraude").names)


def fraud_alerts(
    t: Tables, *, rules: FraudRules = DEFAULT_RULES, instants: DataFrame | None = None
) -> DataFrame:
    """The alerts with client, account and USD amount."""
    scored = score_transactions(t, rules=rules, instants=instants)
    return enriched_alerts(flagged_alerts(scored, rules=rules), t)


# ── the mart ────────────────────────────────────────────────────────────────────────────

def fraud_by_category(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy("categoria")
        .agg(F.count("*").alias("total_fraudes"), as_double(F.sum("monto")).alias("monto_total"))
        .orderBy(F.desc("total_fraudes"), "categoria")
    )


def fraud_by_channel(alerts: DataFrame) -> DataFrame:
    """Alerts per channel and their share of all alerts."""
    grouped = alerts.groupBy("canal").agg(F.count("*").alias("total_fraudes"))
    return with_share(grouped, total="total_fraudes").orderBy(F.desc("total_fraudes"), "canal")


def fraud_by_month(alerts: DataFrame) -> DataFrame:
    return (
        alerts.groupBy(month_label(F.col("fecha")).alias("anio_mes"))
        .agg(F.count("*").alias("total_fraudes"), as_double(F.sum("monto")).alias("monto_total"))
        .orderBy("anio_mes")
    )


def fraud_summary(
    alerts: DataFrame, counted: DataFrame, *, rules: FraudRules = DEFAULT_RULES
) -> DataFrame:
    """One row: alert rate and amounts. ``counted`` has the transactions' number in rows of
    ``n``, as the stored instants do."""
    amounts = alerts.agg(
        F.count("*").alias("total_fraudes"),
        as_double(F.sum("monto")).alias("monto_total_fraude"),
        F.try_divide(as_double(F.sum("monto")), F.count("monto")).alias("monto_promedio_fraude"),
        as_double(F.max("monto")).alias("monto_maximo_fraude"),
        as_double(F.sum("monto_usd")).alias("monto_total_usd"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    row = one_row(counted.agg(total.alias("total_transacciones")), amounts)
    return row.select(
        "total_transacciones",
        "total_fraudes",
        pct_of_counts(F.col("total_fraudes"), F.col("total_transacciones")).alias("tasa_fraude_pct"),
        "monto_total_fraude",
        "monto_promedio_fraude",
        "monto_maximo_fraude",
        "monto_total_usd",
        F.lit(rules.alert_score).alias("score_umbral"),
    )


def mart_aggregates(
    alerts: DataFrame, counted: DataFrame, *, rules: FraudRules = DEFAULT_RULES
) -> dict[str, DataFrame]:
    """The mart's small tables, from alerts that carry their USD amount."""
    return {
        "fraude_por_categoria": fraud_by_category(alerts),
        "fraude_por_canal": fraud_by_channel(alerts),
        "fraude_por_mes": fraud_by_month(alerts),
        "resumen_general": fraud_summary(alerts, counted, rules=rules),
    }


def etl_run(
    spark: SparkSession,
    t: Tables,
    folder: str,
    *,
    staging: str | None = None,
    rules: FraudRules = DEFAULT_RULES,
    source: str = "",
) -> dict[str, str]:
    """Extract, transform, load: scores all transactions and replaces the mart in ``folder``.

    The transactions are read twice: once for the clients' instants, which are stored and
    answer the velocity rule, the amount profile and the total, and once for the score. The
    bare alerts are stored before accounts and rates are added, so these see the alerts only,
    and a lost executor costs no more than its own tasks.

    Every load goes to a new folder below ``folder`` and is committed to the folder's manifest
    when all tables are there; only then are this session's views ``dwh_<name>`` pointed to it.
    Readers, in whatever session, see the load before until then, and a load that fails changes
    nothing. Old loads are left for whoever owns the folder to remove. ``source`` is kept with
    the load to tell later what it was made from. ``staging`` additionally copies the source
    tables there and works from the copy. Returns the written paths.
    """
    if staging is not None:
        extract(t, staging, names=(*BANK_TABLES, "tipo_cambio"))
        t = Tables.from_parquet(spark, staging)
    load = new_load(folder)
    instants = _stored(client_instants(t.transacciones), load, "work_instantes")
    scored = score_transactions(t, rules=rules, instants=instants)
    bare = _stored(flagged_alerts(scored, rules=rules), load, "work_alertas")
    paths = replace_tables({"alertas_fraude": enriched_alerts(bare, t)}, load)
    alerts = spark.read.schema(MART_DDL["alertas_fraude"]).parquet(paths["alertas_fraude"])
    paths |= replace_tables(mart_aggregates(alerts, instants, rules=rules), load)
    commit_load(spark, folder, load, paths, source=source)
    publish_views(spark, paths, MART_DDL)
    return paths


def loaded_mart(
    spark: SparkSession, t: Tables, folder: str, *, source: str, rules: FraudRules = DEFAULT_RULES
) -> Tables:
    """The mart in ``folder``, loaded first if its current load is of another source or rules.

    ``source`` names the state of the source tables, such as :func:`source_version` of their
    folder. What any session loaded before serves all others.
    """
    made_from = f"{source} {rules}"
    found = current_load(spark, folder)
    if found is None or found.source != made_from:
        etl_run(spark, t, folder, rules=rules, source=made_from)
    return open_mart(spark, folder)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = os.path.join(folder, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
