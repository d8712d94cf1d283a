"""Client and transaction lookups (D1-D9).

The per-client lookups take one id, a list of ids or a DataFrame with ``id_cliente``, and
answer for all of them in one job; the ids cut the tables down before anything else is done.
Ids that are no client's give no rows. Results for named ids are sorted, those for all clients
or a DataFrame of ids only with ``ordered=True``, as a bulk export does not need it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caudal.functions.dates import as_date, instant, whole_days
from caudal.functions.text import contains_ci
from caudal.operators.ranking import latest_per_key, page_after, page_info, page_of
from caudal.operators.spread import plain_side
from caudal.sources.layouts import stored_page, write_pages
from caudal.sources.tables import Tables

Ids = str | list[str] | DataFrame


# ── clients ─────────────────────────────────────────────────────────────────────────────

def clientes_filtrados(
    t: Tables,
    *,
    nombre: str | None = None,
    segmento: str | None = None,
    riesgo: str | None = None,
) -> DataFrame:
    """Clients by name fragment, segment and risk level; every filter given must hold."""
    clientes = t.clientes
    if nombre:
        clientes = clientes.filter(
            contains_ci(F.col("nombre"), nombre) | contains_ci(F.col("apellido_paterno"), nombre)
        )
    related = None
    if segmento:
        related = F.col("segmento_cliente") == segmento
    if riesgo:
        level = F.col("nivel_riesgo") == riesgo
        related = level if related is None else related & level
    if related is not None:
        keep = t.open_data.filter(related).select("id_cliente")
        clientes = clientes.join(keep, "id_cliente", "left_semi")
    return clientes


def _with_satellites(t: Tables, page: DataFrame) -> DataFrame:
    """Open data and contact columns of the clients on one page.

    Both satellites are cut down to the page's clients first. How that is done is left to
    Spark, which knows the page's size when it gets there.
    """
    on_page = page.select("id_cliente")
    profile = t.open_data.join(on_page, "id_cliente", "left_semi").select(
        "id_cliente", "segmento_cliente", "nivel_riesgo", "score_crediticio"
    )
    contact = t.datos_personales.join(on_page, "id_cliente", "left_semi").select(
        "id_cliente", "email", "ciudad", "estado"
    )
    return page.join(profile, "id_cliente", "left").join(contact, "id_cliente", "left")


_BY_SURNAME = ("apellido_paterno", "id_cliente")


def clientes_list(
    t: Tables,
    *,
    page: int = 1,
    limit: int = 20,
    nombre: str | None = None,
    segmento: str | None = None,
    riesgo: str | None = None,
) -> DataFrame:
    """One page of clients by surname, with open data and contact columns."""
    kept = clientes_filtrados(t, nombre=nombre, segmento=segmento, riesgo=riesgo)
    chosen = page_of(kept, page, limit, *_BY_SURNAME)
    return _with_satellites(t, chosen).orderBy(*_BY_SURNAME)


def clientes_list_after(
    t: Tables, *, apellido_paterno: str, id_cliente: str, limit: int = 20, **filters
) -> DataFrame:
    """The page after a known last client, at the cost of a first page."""
    surname, key = F.col("apellido_paterno"), F.col("id_cliente")
    beyond = (surname > apellido_paterno) | ((surname == apellido_paterno) & (key > id_cliente))
    chosen = page_after(clientes_filtrados(t, **filters), limit, beyond, *_BY_SURNAME)
    return _with_satellites(t, chosen).orderBy(*_BY_SURNAME)


def clientes_list_info(t: Tables, *, page: int = 1, limit: int = 20, **filters) -> DataFrame:
    return page_info(clientes_filtrados(t, **filters), page, limit)


def store_clientes(t: Tables, folder: str, *, rows_per_part: int | None = None, **filters) -> None:
    """Stores the filtered clients by surname, so that any page of them is a read of its rows."""
    sizes = {} if rows_per_part is None else {"rows_per_part": rows_per_part}
    write_pages(clientes_filtrados(t, **filters), folder, *_BY_SURNAME, **sizes)


def clientes_stored_page(
    spark: SparkSession, t: Tables, folder: str, *, page: int = 1, limit: int = 20
) -> DataFrame:
    """As :func:`clientes_list`, from a stored list; page 10,000 costs what page 1 does."""
    return _with_satellites(t, stored_page(spark, folder, page, limit)).orderBy(*_BY_SURNAME)


def _known_clients(t: Tables, ids: Ids | None) -> DataFrame:
    """The asked-for ids that are clients (all clients when ``ids`` is None)."""
    clientes = t.clientes
    if ids is None:
        return clientes
    if isinstance(ids, DataFrame):
        return clientes.join(ids.select("id_cliente").distinct(), "id_cliente", "left_semi")
    wanted = [ids] if isinstance(ids, str) else ids
    return clientes.filter(F.col("id_cliente").isin(*wanted))


def cliente_perfil(t: Tables, ids: Ids | None = None) -> DataFrame:
    """Clients with their three one-to-one records nested; NULL where a client has none.

    All four tables are unique by client and join on the same key, so each is shuffled
    once and no key can be skewed.
    """
    profile = _known_clients(t, ids)
    for satellite in ("datos_personales", "datos_negocio", "open_data"):
        frame = t[satellite]
        nested = F.struct(*[c for c in frame.columns if c != "id_cliente"]).alias(satellite)
        profile = profile.join(frame.select("id_cliente", nested), "id_cliente", "left")
    return profile


def _of_ids(rows: DataFrame, key: str, ids: Ids | None) -> DataFrame:
    """The rows of the asked-for ids: pushed into the scan, or a semi join with a frame."""
    if ids is None:
        return rows
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(key).distinct(), key, "left_semi")
    return rows.filter(F.col(key).isin([ids] if isinstance(ids, str) else ids))


def _children(t: Tables, child: str, ids: Ids | None) -> DataFrame:
    """Rows of ``child`` whose client exists (and is asked for).

    A semi join on the left: AQE cuts a client with very many rows into several tasks.
    """
    rows, parents = t[child], _known_clients(t, ids).select("id_cliente")
    if isinstance(ids, DataFrame):
        # The parents are cut down to the ids already.
        return rows.join(plain_side(parents), "id_cliente", "left_semi")
    return _of_ids(rows, "id_cliente", ids).join(parents, "id_cliente", "left_semi")


def _sorted(
    df: DataFrame, ids: Ids | None, ordered: bool | None, *order: Column | str
) -> DataFrame:
    if ordered is None:
        ordered = isinstance(ids, (str, list))
    return df.orderBy("id_cliente", *order) if ordered else df


def cliente_cuentas(
    t: Tables, ids: Ids | None = None, *, ordered: bool | None = None
) -> DataFrame:
    """Accounts, latest opening first (an unknown date leads)."""
    rows = _children(t, "cuentas", ids)
    return _sorted(rows, ids, ordered, F.desc_nulls_first("fecha_apertura"), "num_cuenta")


def cliente_transacciones(
    t: Tables, ids: Ids | None = None, *, limit: int = 50, ordered: bool | None = None
) -> DataFrame:
    """The latest ``limit`` transactions of each client.

    Cut down to the asked-for ids, trimmed to ``limit`` per client, and only then checked
    against the clients, so what that join moves does not grow with a client's history.
    """
    latest = latest_per_key(
        _of_ids(t.transacciones, "id_cliente", ids), "id_cliente", limit, "fecha",
        F.asc("id_transaccion"),
    )
    parents = _known_clients(t, ids).select("id_cliente")
    known = latest.join(parents, "id_cliente", "left_semi")
    return _sorted(known, ids, ordered, F.desc("fecha"), "id_transaccion")


def cliente_prestamos(
    t: Tables, ids: Ids | None = None, *, ordered: bool | None = None
) -> DataFrame:
    rows = _children(t, "prestamos", ids)
    return _sorted(rows, ids, ordered, F.desc_nulls_first("fecha_otorgamiento"), "id_prestamo")


def cliente_tarjetas(t: Tables, ids: Ids | None = None) -> DataFrame:
    return _children(t, "tarjetas", ids)


def cliente_metas(
    t: Tables, ids: Ids | None = None, *, ordered: bool | None = None
) -> DataFrame:
    """Savings goals, nearest target date first (an unknown date comes last)."""
    rows = _children(t, "metas_ahorro", ids)
    return _sorted(rows, ids, ordered, F.asc_nulls_last("fecha_objetivo"), "id_meta")


# ── transactions ────────────────────────────────────────────────────────────────────────

def transacciones_filtradas(
    t: Tables,
    *,
    desde: str | dt.date | dt.datetime | None = None,
    hasta: str | dt.date | dt.datetime | None = None,
    categoria: str | None = None,
    canal: str | None = None,
    fraude: bool | None = None,
    tipo: str | None = None,
) -> DataFrame:
    """Transactions by period and by equality on up to four columns.

    A date bound covers the whole day; a datetime bound is that exact instant, inclusive.
    """
    at = F.col("fecha")
    keep: Column = F.lit(True)
    if isinstance(desde, dt.datetime):
        keep = keep & (at >= instant(desde))
    elif desde is not None:
        keep = keep & whole_days(at, as_date(desde), None)
    if isinstance(hasta, dt.datetime):
        keep = keep & (at <= instant(hasta))
    elif hasta is not None:
        keep = keep & whole_days(at, None, as_date(hasta))
    for column, value in (("categoria", categoria), ("canal", canal), ("tipo", tipo)):
        if value:
            keep = keep & (F.col(column) == value)
    if fraude is not None:
        keep = keep & (F.col("es_fraude_potencial") == fraude)
    return t.transacciones.filter(keep)


def _with_client_name(t: Tables, few: DataFrame) -> DataFrame:
    """Transactions of known clients, with the name."""
    names = t.clientes.select("id_cliente", "nombre", "apellido_paterno")
    return few.join(names, "id_cliente").select(*few.columns, "nombre", "apellido_paterno")


def transacciones_list(t: Tables, *, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    """One page of transactions, newest first, with the client's name."""
    kept = transacciones_filtradas(t, **filters)
    chosen = page_of(kept, page, limit, F.desc("fecha"), "id_transaccion")
    return _with_client_name(t, chosen).orderBy(F.desc("fecha"), "id_transaccion")


def transacciones_list_after(
    t: Tables, *, fecha: dt.datetime, id_transaccion: str, limit: int = 50, **filters
) -> DataFrame:
    """The page after a known last transaction, at the cost of a first page."""
    at, key = F.col("fecha"), F.col("id_transaccion")
    beyond = (at < instant(fecha)) | ((at == instant(fecha)) & (key > id_transaccion))
    kept = transacciones_filtradas(t, **filters)
    chosen = page_after(kept, limit, beyond, F.desc("fecha"), "id_transaccion")
    return _with_client_name(t, chosen).orderBy(F.desc("fecha"), "id_transaccion")


def store_transacciones(t: Tables, folder: str, *, rows_per_part: int | None = None, **filters) -> None:
    """Stores the filtered transactions, newest first, so that any page is a read of its rows."""
    sizes = {} if rows_per_part is None else {"rows_per_part": rows_per_part}
    kept = transacciones_filtradas(t, **filters)
    write_pages(kept, folder, F.desc("fecha"), "id_transaccion", **sizes)


def transacciones_stored_page(
    spark: SparkSession, t: Tables, folder: str, *, page: int = 1, limit: int = 50
) -> DataFrame:
    """As :func:`transacciones_list`, from a stored list; page 10,000 costs what page 1 does."""
    chosen = stored_page(spark, folder, page, limit)
    return _with_client_name(t, chosen).orderBy(F.desc("fecha"), "id_transaccion")


def transacciones_list_info(t: Tables, *, page: int = 1, limit: int = 50, **filters) -> DataFrame:
    return page_info(transacciones_filtradas(t, **filters), page, limit)


def transaccion_detalle(
    t: Tables, ids: str | list[str] | DataFrame | None = None
) -> DataFrame:
    """Transactions by id (all of them when ``ids`` is None), each with its client's name."""
    return _with_client_name(t, _of_ids(t.transacciones, "id_transaccion", ids))
