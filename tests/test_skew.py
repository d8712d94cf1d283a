"""Hot keys: one client with most of the rows is several tasks, and results stay the same."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
import pandas as pd
from pyspark.sql import functions as F

from caudal.operators.ranking import latest_per_key
from caudal.plans import fraud, lookups
from caudal.session import settings
from caudal.sources.tables import Tables
from tests.conftest import plan_of

ROWS = 60_000


@pytest.fixture
def hot_bank(spark, bank, tmp_path):
    """A third of the transactions are one client's, a tenth have no client."""
    n = F.col("id")
    tx = spark.range(ROWS).select(
        F.concat(F.lit("T"), n).alias("id_transaccion"),
        F.when(n % 10 == 9, None).when(n % 3 == 0, "C0").otherwise(F.concat(F.lit("C"), n % 500)).alias("id_cliente"),
        F.concat(F.lit("A"), n % 700).alias("num_cuenta"),
        F.timestamp_micros(n * 977_000_003 % 2_592_000_000_000).cast("timestamp_ntz").alias("fecha"),
        (n % 1000).cast("decimal(12,2)").alias("monto"),
        *[F.lit(None).cast("string").alias(c) for c in ("tipo", "categoria", "canal")],
        # Something that does not compress, so that sizes tell the rows.
        F.sha2(n.cast("string"), 512).alias("comercio"),
        *[F.lit(None).cast("decimal(9,6)").alias(c) for c in ("latitud", "longitud")],
        F.lit(False).alias("es_fraude_potencial"),
    )
    tx.repartition(8).write.parquet(str(tmp_path / "tx"))
    clients = [f"C{i}" for i in range(400)]
    made = bank(
        clientes=[{"id_cliente": c, "nombre": "n", "apellido_paterno": "a"} for c in clients],
        datos_personales=[{"id_cliente": c, "latitud_habitual": D(1), "longitud_habitual": D(1)} for c in clients],
    )
    for name in ("clientes", "datos_personales"):
        made[name].write.parquet(str(tmp_path / name))
    paths = {"transacciones": "tx", "clientes": "clientes", "datos_personales": "datos_personales"}
    return Tables(lambda name: spark.read.parquet(str(tmp_path / paths[name])) if name in paths else made[name])


# No broadcast, and partitions so small that a third of these rows is skewed.
SPLITTING = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold": "0",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "32k",
    "spark__sql__files__maxPartitionBytes": "64k",
    "spark__sql__files__openCostInBytes": "4k",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "32k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize("job", [
    lambda t: fraud.fraud_r1_geo(t), lambda t: fraud.fraud_r3_amount(t),
    lambda t: fraud.score_transactions(t), lambda t: lookups.transaccion_detalle(t),
])
def test_a_hot_client_is_split(spark, hot_bank, job):
    with settings(spark, **SPLITTING):
        # mapInPandas sees the tasks as they are and lets nothing be planned differently.
        sizes = job(hot_bank).mapInPandas(
            lambda parts: iter([pd.DataFrame({"n": [sum(len(p) for p in parts)]})]), "n long"
        )
        counted = [r.n for r in sizes.collect()]
        assert "skew=true" in plan_of(sizes)
    assert sum(counted) == job(hot_bank).count()
    # The client alone has 18,000 of 60,000 rows.
    assert max(counted) < 14_000


@pytest.mark.parametrize("n", [1, 50, 1500])
def test_latest_rows_of_a_hot_client(spark, hot_bank, n):
    tx = hot_bank.transacciones.filter("id_cliente IS NOT NULL")
    got = latest_per_key(tx, "id_cliente", n, "fecha", F.asc("id_transaccion"))
    rows = {}
    for r in tx.select("id_cliente", "fecha", "id_transaccion").collect():
        rows.setdefault(r.id_cliente, []).append((r.fecha, r.id_transaccion))
    expected = set()
    for key, found in rows.items():
        found.sort(key=lambda x: x[1])
        found.sort(key=lambda x: x[0], reverse=True)
        expected |= {(key, i) for _, i in found[:n]}
    assert {(r.id_cliente, r.id_transaccion) for r in got.select("id_cliente", "id_transaccion").collect()} == expected
