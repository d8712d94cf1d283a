"""Streams run in several batches give what the batch jobs give, after every batch."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caudal.operators.rolling import busy_instants, counts_per_instant
from caudal.plans.fraud import FraudRules
from caudal.schemas import schema
from caudal.streaming import jobs

RULES = FraudRules(max_tx=2, window_seconds=3600)
START = dt.datetime(2024, 1, 1, 22, 0)
TOTALS = ["desde", "hasta", "canal"]


@pytest.fixture
def feed(spark, frame, tmp_path):
    """add(batch) puts transactions into the folder; stream() and table() read it."""

    class Feed:
        folder = str(tmp_path / "in")
        run = str(tmp_path / "run")

        def add(self, batch):
            rows = [
                {"id_transaccion": f"{c}{m}-{i}", "id_cliente": c, "canal": "App", "monto": Decimal(1),
                 "fecha": START + dt.timedelta(minutes=m)}
                for i, (c, m) in enumerate(batch)
            ]
            frame("transacciones", rows).coalesce(1).write.mode("append").parquet(self.folder)

        def stream(self):
            found = spark.readStream.schema(schema("transacciones")).option("maxFilesPerTrigger", 1)
            return found.parquet(self.folder).withColumn("fecha", F.col("fecha").cast("timestamp"))

        def table(self):
            return spark.read.schema(schema("transacciones")).parquet(self.folder)

    return Feed()


# Late rows within the hour, ties, and midnight; the last batch only moves the watermark on.
BATCHES = [
    [("a", 0), ("a", 30), ("b", 10), ("b", 10)],
    [("a", 50), ("a", 20), ("b", 10), ("c", 100)],
    [("a", 130), ("c", 110), ("c", 125), ("b", 200)],
    [("c", 126), ("z", 2000)],
]


def test_exact_velocity_equals_batch_after_every_batch(spark, feed):
    sizes = []
    for batch in BATCHES:
        feed.add(batch)
        stream = jobs.exact_velocity_stream(feed.stream(), rules=RULES)
        jobs.run_batches(stream, feed.run)
        found = jobs.current_rows(spark, feed.run, stream.schema, ["desde", "id_cliente"])
        got = [(r.id_cliente, r.fecha) for r in jobs.flagged_instants(found).collect()]
        whole = busy_instants(
            counts_per_instant(feed.table(), "id_cliente", "fecha"), "id_cliente", "fecha",
            more_than=RULES.max_tx, within_seconds=RULES.window_seconds,
        )
        assert sorted(got) == sorted((r.id_cliente, r.fecha) for r in whole.collect())
        sizes.append(len(got))
    assert sizes == [0, 3, 4, 5]


@pytest.mark.parametrize("limit", [0, 1, 40])
def test_exact_velocity_for_any_limit(spark, feed, limit):
    rules = FraudRules(max_tx=limit, window_seconds=1800)
    feed.add([("a", m // 3) for m in range(150)] + [("b", 0), ("b", 30), ("b", 59)])
    stream = jobs.exact_velocity_stream(feed.stream(), rules=rules)
    jobs.run_batches(stream, feed.run)
    found = jobs.current_rows(spark, feed.run, stream.schema, ["desde", "id_cliente"])
    whole = busy_instants(
        counts_per_instant(feed.table(), "id_cliente", "fecha"), "id_cliente", "fecha",
        more_than=limit, within_seconds=1800,
    )
    got = {(r.id_cliente, r.fecha) for r in jobs.flagged_instants(found).collect()}
    assert got == {(r.id_cliente, r.fecha) for r in whole.collect()} and got


def test_channel_totals_are_complete_after_every_batch(spark, feed):
    for batch in BATCHES:
        feed.add(batch)
        stream = jobs.channel_totals_stream(feed.stream())
        jobs.run_batches(stream, feed.run)
        found = jobs.current_rows(spark, feed.run, stream.schema, TOTALS)
        got = {r.desde: (r.total, r.monto_total) for r in found.collect()}
        hours = feed.table().groupBy(F.date_trunc("hour", "fecha").alias("hora")).agg(
            F.count("*").alias("n"), F.sum("monto").cast("double").alias("monto")
        )
        assert got == {r.hora: (r.n, r.monto) for r in hours.collect()}
    # What later batches touched is there once for each of them; readers see the newest.
    assert jobs.written_rows(spark, feed.run, stream.schema).count() > found.count()


def test_a_repeated_batch_changes_nothing(spark, feed):
    for batch in BATCHES[:2]:
        feed.add(batch)
    stream = jobs.channel_totals_stream(feed.stream())
    jobs.run_batches(stream, feed.run)
    before = sorted(jobs.written_rows(spark, feed.run, stream.schema).collect())
    again = spark.createDataFrame([tuple(r)[:-1] for r in before if r.lote == 0], stream.schema)
    jobs.batch_writer(f"{feed.run}/out")(again, 0)
    assert sorted(jobs.written_rows(spark, feed.run, stream.schema).collect()) == before
    jobs.run_batches(jobs.channel_totals_stream(feed.stream()), feed.run)
    assert sorted(jobs.written_rows(spark, feed.run, stream.schema).collect()) == before


def test_no_batch_yet(spark, feed):
    feed.add([("a", 0)])
    declared = jobs.channel_totals_stream(feed.stream()).schema
    assert jobs.current_rows(spark, feed.run, declared, TOTALS).collect() == []


def test_sliding_velocity_gives_open_windows_too(spark, feed):
    feed.add([("a", 0), ("a", 1), ("a", 2), ("a", 3)])
    stream = jobs.sliding_velocity_stream(feed.stream(), more_than=3)
    jobs.run_batches(stream, feed.run)
    found = jobs.current_rows(spark, feed.run, stream.schema, ["desde", "hasta", "id_cliente"])
    assert [r.total for r in found.collect()] == [4] * 12


def test_rows_later_than_the_delay_are_left_out(spark, feed):
    # A batch drops what is older than the watermark the batch before it ran with.
    for batch in ([("a", 0)], [("a", 600)], [("a", 605)], [("a", 5)], [("a", 1300)]):
        feed.add(batch)
        stream = jobs.channel_totals_stream(feed.stream())
        jobs.run_batches(stream, feed.run)
    found = jobs.current_rows(spark, feed.run, stream.schema, TOTALS)
    assert sorted(r.total for r in found.collect()) == [1, 1, 2]


def test_stateless_rules_split_no_rows(spark, feed):
    feed.add([("a", 0), ("b", 200), (None, 1)])
    feed.add([("a", 241)])
    location = spark.createDataFrame([("a", 1.0, 2.0)], "id_cliente string, latitud_habitual double, longitud_habitual double")
    jobs.run_batches(feed.stream(), feed.run, job=lambda tx: jobs.stateless_rules(tx, location))
    declared = jobs.stateless_rules(feed.table(), location).schema
    rows = jobs.written_rows(spark, feed.run, declared).collect()
    assert sorted((r.id_transaccion, r.r4_hora, r.lote) for r in rows) == sorted(
        [("a0-0", False, 0), ("b200-1", True, 0), ("None1-2", False, 0), ("a241-0", True, 1)]
    )


def test_sliding_velocity_keeps_two_states_a_row_at_most(spark, feed):
    feed.add([("a", m % 60) for m in range(200)] + [("b", 0)])
    stream = jobs.sliding_velocity_stream(feed.stream(), more_than=3)
    jobs.run_batches(stream, feed.run, **jobs.ON_DISK)
    states = spark.read.format("statestore").load(f"{feed.run}/checkpoint")
    # A state row per window made 23 of the first client and 12 of the second.
    assert states.count() <= 4


@pytest.mark.parametrize("window, slide", [("1 hour", "5 minutes"), ("25 minutes", "10 minutes")])
def test_sliding_velocity_equals_batch_after_every_batch(spark, feed, window, slide):
    # The last of the batches comes too late for windows this short.
    for batch in BATCHES[:3]:
        feed.add([*batch, (None, batch[0][1])])
        stream = jobs.sliding_velocity_stream(feed.stream(), more_than=0, window=window, slide=slide)
        jobs.run_batches(stream, feed.run)
        found = jobs.current_rows(spark, feed.run, stream.schema, ["desde", "hasta", "id_cliente"])
        whole = (
            feed.table().withColumn("fecha", F.col("fecha").cast("timestamp"))
            .groupBy(F.window("fecha", window, slide).alias("v"), "id_cliente").agg(F.count("*").alias("total"))
            .select("v.start", "v.end", "id_cliente", "total")
        )
        assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, whole.collect())))
