"""Committed loads: what other sessions see, and what a load that was cut off changes."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from caudal.plans import fraud, fraud_mart
from caudal.schemas import MART_DDL
from caudal.sources import mart
from caudal.sources.sinks import new_load, replace_tables
from tests.conftest import rows_of

SERVED = {
    "E1": fraud_mart.etl_resumen,
    "E2": fraud_mart.etl_fraude_por_categoria,
    "E3": fraud_mart.etl_fraude_por_canal,
    "E4": fraud_mart.etl_fraude_por_mes,
    "E7": lambda m: fraud_mart.etl_alertas_fraude(m, page=1, limit=10),
}


@pytest.fixture
def small_bank(bank):
    """One client whose night transactions are far from home: an alert each."""
    def make(nights):
        return bank(
            clientes=[{"id_cliente": "a", "nombre": "Ana"}],
            datos_personales=[{"id_cliente": "a", "latitud_habitual": Decimal(0), "longitud_habitual": Decimal(0)}],
            transacciones=[
                {"id_transaccion": f"t{n}", "id_cliente": "a", "monto": Decimal(10 + n), "canal": "Web", "categoria": "x",
                 "latitud": Decimal(40), "longitud": Decimal(40), "fecha": dt.datetime(2024, 1, 1 + n, 2)}
                for n in range(nights)
            ],
            tipo_cambio=[{"fecha": dt.date(2024, 1, 1), "rate": Decimal(2)}],
        )

    return make


def served(spark, folder):
    tables = mart.open_mart(spark, folder)
    return {name: rows_of(query(tables)) for name, query in SERVED.items()}


def test_a_second_session_serves_without_loading(spark, small_bank, tmp_path, monkeypatch):
    folder = str(tmp_path / "mart")
    fraud.loaded_mart(spark, small_bank(3), folder, source="v1")
    here = served(spark, folder)
    assert here["E1"][0]["total_fraudes"] == 3 and len(here["E7"]) == 3
    other = spark.newSession()
    assert not [t for t in other.catalog.listTables() if t.name.startswith("dwh_")]
    monkeypatch.setattr(fraud, "etl_run", lambda *a, **k: pytest.fail("loaded again"))
    fraud.loaded_mart(other, small_bank(3), folder, source="v1")
    assert served(other, folder) == here
    mart.publish_current(other, folder)
    assert rows_of(fraud_mart.etl_resumen(fraud_mart.mart_views(other))) == here["E1"]


def test_another_source_or_other_rules_load_anew(spark, small_bank, tmp_path):
    folder = str(tmp_path / "mart")
    for source, nights, rules in (("v1", 2, fraud.DEFAULT_RULES), ("v2", 4, fraud.DEFAULT_RULES), ("v2", 4, fraud.FraudRules(alert_score=9))):
        fraud.loaded_mart(spark, small_bank(nights), folder, source=source, rules=rules)
    found = mart.loads(spark, folder).select("carga", "origen").distinct().orderBy("carga").collect()
    assert len(found) == 3
    assert served(spark, folder)["E1"][0]["total_fraudes"] == 0
    # An earlier load by its name.
    before = mart.open_mart(spark, folder, load=found[0].carga)
    assert rows_of(fraud_mart.etl_resumen(before))[0]["total_fraudes"] == 2


def test_a_load_cut_off_changes_nothing(spark, small_bank, tmp_path, monkeypatch):
    folder = str(tmp_path / "mart")
    fraud.etl_run(spark, small_bank(2), folder, source="v1")
    before = served(spark, folder)

    def broken(*args, **kwargs):
        raise RuntimeError("cut off")

    # All tables written, not committed.
    with monkeypatch.context() as m:
        m.setattr(fraud, "commit_load", broken)
        with pytest.raises(RuntimeError):
            fraud.etl_run(spark, small_bank(5), folder, source="v2")
    # Some tables written.
    with monkeypatch.context() as m:
        m.setattr(fraud, "mart_aggregates", broken)
        with pytest.raises(RuntimeError):
            fraud.etl_run(spark, small_bank(5), folder, source="v2")
    assert served(spark, folder) == before == served(spark.newSession(), folder)
    assert mart.current_load(spark, folder).source == "v1"


def test_an_incomplete_entry_is_no_load(spark, tmp_path):
    folder = str(tmp_path / "mart")
    assert mart.current_load(spark, folder) is None
    assert mart.loads(spark, folder).collect() == []
    assert all(mart.open_mart(spark, folder)[name].collect() == [] for name in MART_DDL)
    load = new_load(folder)
    frames = {name: spark.createDataFrame([], MART_DDL[name]) for name in ("fraude_por_mes", "fraude_por_canal")}
    paths = replace_tables(frames, load)
    entries = mart.loads(spark, folder).schema
    half = [("load-9", "fraude_por_mes", "load-9/x", 2, "", None)]
    spark.createDataFrame(half, entries).write.mode("append").parquet(f"{folder}/{mart.MANIFEST}")
    assert mart.current_load(spark, folder) is None
    mart.commit_load(spark, folder, load, paths)
    found = mart.current_load(spark, folder)
    assert found.paths == paths and found.name == load.rpartition("/")[2]
    assert len([p for p in (tmp_path / "mart" / mart.MANIFEST).glob("*.parquet")]) >= 1


def test_a_source_folder_that_changes_has_another_version(spark, tmp_path):
    folder = str(tmp_path / "source")
    spark.range(3).write.parquet(f"{folder}/a.parquet")
    first = mart.source_version(spark, folder)
    assert mart.source_version(spark.newSession(), folder) == first
    spark.range(4).write.mode("append").parquet(f"{folder}/a.parquet")
    assert mart.source_version(spark, folder) != first
