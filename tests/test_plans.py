"""Physical plans: what reaches the scan, what never appears."""

from __future__ import annotations

import pytest

from caudal.catalog import STREAM_QUERIES, all_queries
from caudal.plans import fraud, history, kpis, lookups, report
from caudal.sources.sample_bank import sample_bank
from caudal.sources.tables import Tables, extract
from pyspark.sql import functions as F
from tests.conftest import SAMPLE, plan_of

# These write while they are built.
EAGER = {"etl_run", "etl_tipo_cambio_csv", *STREAM_QUERIES}
BATCH = sorted(set(all_queries()) - EAGER)


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(name, spark):
    plan = plan_of(all_queries()[name](spark, SAMPLE))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The sample written in the banking schema."""
    folder = str(tmp_path_factory.mktemp("bank"))
    extract(sample_bank(spark, SAMPLE), folder)
    return Tables.from_parquet(spark, folder)


def test_year_filter_reaches_the_scan(stored):
    plan = plan_of(history.ctx_tx_anual(stored, years=[1996, 1997]))
    assert "GreaterThanOrEqual(fecha,1996-01-01T00:00)" in plan
    assert "LessThan(fecha,1998-01-01T00:00)" in plan


def test_period_filter_reaches_the_scan_and_columns_are_pruned(stored):
    plan = plan_of(kpis.kpi_canal_periodo(stored, desde="1996-01-01", hasta="1996-06-30"))
    assert "LessThan(fecha,1996-07-01T00:00)" in plan
    assert "IsNotNull(canal)" in plan
    assert "ReadSchema: struct<fecha:timestamp_ntz,monto:decimal(12,2),canal:string>" in plan


def test_status_filter_reaches_the_scan(stored):
    assert "EqualTo(estatus,Activa)" in plan_of(kpis.kpi_saldo_por_tipo_cuenta(stored))


def test_headline_numbers_scan_each_table_once(stored):
    assert plan_of(kpis.kpi_resumen(stored)).count("FileScan") == 5
    assert plan_of(kpis.resumen_y_debilidades(stored)).count("FileScan") == 6


def test_named_ids_reach_the_scan(stored):
    plan = plan_of(lookups.cliente_cuentas(stored, ["C1", "C2"]))
    assert "In(id_cliente, [C1,C2])" in plan
    assert "Exchange hashpartitioning" not in plan


def test_latest_per_client_is_trimmed_before_the_shuffle(stored):
    plan = plan_of(lookups.cliente_transacciones(stored, limit=5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_pages_are_top_k(stored):
    assert "TakeOrderedAndProject" in plan_of(lookups.transacciones_list(stored, page=2, limit=10))


def test_lookups_by_a_frame_of_ids_cut_first(stored, spark):
    """The ids meet the transactions before these are ranked."""
    ids = spark.createDataFrame([("C1",)], "id_cliente string")
    plan = plan_of(lookups.cliente_transacciones(stored, ids, limit=5))
    assert plan.index("WindowGroupLimit") < plan.index("LeftSemi") or "LeftSemi" in plan.split("WindowGroupLimit")[-1]


def test_no_broadcast_is_forced():
    """Joins are left to measured sizes; the calendar of days is the one exception."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "caudal"
    forced = [p.name for p in root.rglob("*.py") if "llm" not in p.parts and "F.broadcast(" in p.read_text()]
    assert forced == ["asof.py"]


def reads_of(df, table: str) -> int:
    """Scans of a table's files in the plan that ran."""
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    return sum("FileScan parquet" in line and f"/{table}]" in line for line in final.splitlines())


def test_the_report_reads_the_transactions_twice(stored):
    """Once for everything, once for the latest date."""
    assert reads_of(report.rep_reporte(stored), "transacciones") <= 2
    assert reads_of(report.rep_reporte(stored, as_of="1999-01-01"), "transacciones") == 1


def test_the_score_reads_the_transactions_once_beside_the_instants(stored, spark, tmp_path):
    fraud.client_instants(stored.transacciones).write.parquet(str(tmp_path / "instantes"))
    instants = spark.read.parquet(str(tmp_path / "instantes"))
    assert reads_of(fraud.score_transactions(stored, instants=instants), "transacciones") == 1
    assert reads_of(fraud.client_instants(stored.transacciones), "transacciones") == 1
