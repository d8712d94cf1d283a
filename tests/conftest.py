"""One session for all tests, and banking tables made of a few rows."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caudal.schemas import BANK_TABLES, schema  # noqa: E402
from caudal.session import build_session  # noqa: E402
from caudal.sources.tables import Tables  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "caudal-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(table, [{column: value}, ...]): rows of a banking table, the rest NULL."""

    def make(table: str, rows: list[dict]):
        declared = schema(table)
        data = [tuple(row.get(f.name) for f in declared.fields) for row in rows]
        return spark.createDataFrame(data, declared)

    return make


@pytest.fixture
def bank(frame):
    """bank(cuentas=[...], ...): the banking tables; those not named are empty."""

    def make(**rows) -> Tables:
        return Tables.from_frames({
            name: frame(name, rows.get(name, [])) for name in (*BANK_TABLES, "tipo_cambio")
        })

    return make


def rows_of(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
