"""Streaming versions of the transaction and fraud jobs (T1-T4).

The ``*_stream`` functions turn a streaming frame of transactions into a streaming result in update
mode: each micro-batch gives the new totals of what its rows touched. :func:`run_upserts` writes
every batch to a folder of its own number and :func:`current_rows` reads the newest row of each
key, so results are complete after every batch and a batch that is run again changes nothing.
The ``replay_*`` functions run one over the sample's events with an available-now trigger and
return its current rows; output and checkpoint go to the shared folder.

Event time is ``fecha`` as a zoned timestamp, since watermarks need one.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caudal.functions.numbers import count_true
from caudal.plans.fraud import DEFAULT_RULES, FraudRules, is_far, is_odd_hour, usual_location
from caudal.session import scratch_path, settings
from caudal.sources.sample_bank import PROJECTIONS, SAMPLE_DDL, sample_bank

DELAY = "1 hour"
# Batch number of a written row.
BATCH = "lote"
# State on disk, with bounded memory, for runs whose state has a row per client and hour.
ON_DISK = {
    "spark__sql__streaming__stateStore__providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark__sql__streaming__stateStore__rocksdb__allowFAllocate": "false",
}


# ── jobs ────────────────────────────────────────────────────────────────────────────────

def channel_totals_stream(tx: DataFrame, *, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """T1: transactions, amount and flagged ones per tumbling window and channel."""
    return (
        tx.withWatermark("fecha", delay)
        .groupBy(F.window("fecha", window).alias("v"), "canal")
        .agg(
            F.count("*").alias("total"),
            F.sum("monto").alias("monto_total"),
            count_true(F.col("es_fraude_potencial")).alias("fraudes"),
        )
        .select(
            F.col("v.start").alias("desde"), F.col("v.end").alias("hasta"), "canal", "total",
            F.col("monto_total").cast("double").alias("monto_total"), "fraudes",
        )
    )


def sliding_velocity_stream(
    tx: DataFrame,
    *,
    more_than: int = DEFAULT_RULES.max_tx,
    window: str = "1 hour",
    slide: str = "5 minutes",
    delay: str = DELAY,
) -> DataFrame:
    """T2: clients with too many transactions in a sliding window (a coarse velocity rule).

    A row is in ``window / slide`` windows, but its state is not. A client's time is cut into slices
    as long as the window, and the state of a slice is how many rows each step of time has that
    the windows beginning in it can reach: a fixed number of counters, however many rows there
    are, and a row is in two slices at most. A batch gives all windows of the slices it touched.
    A slice is dropped once the watermark has passed its last window; until then it takes rows
    that are later than the delay.
    """
    length, move = _micros(tx.sparkSession, window), _micros(tx.sparkSession, slide)
    step = math.gcd(length, move)
    starts = -(-length // move)
    span, reach = starts * move, (starts - 1) * move + length
    sliced = tx.withWatermark("fecha", delay).select(
        F.window("fecha", f"{reach} microseconds", f"{span} microseconds").alias("v"), "id_cliente", "fecha"
    )
    place = F.unix_micros("fecha") - F.unix_micros("v.start")
    counted = (
        sliced.select("v", "id_cliente", F.floor(place / step).alias("paso"))
        .groupBy("v", "id_cliente")
        .agg(*[F.count_if(F.col("paso") == at).alias(f"n{at}") for at in range(reach // step)])
    )
    steps = F.array(*[F.col(f"n{at}") for at in range(reach // step)])
    total_from = lambda first: F.aggregate(
        F.slice("pasos", first * (move // step) + 1, length // step), F.lit(0).cast("long"), lambda n, m: n + m
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.lit(starts - 1)),
        lambda first: F.struct((F.col("inicio") + first * F.lit(move).cast("long")).alias("al"), total_from(first).alias("total")),
    )
    # Windows without a row are none, whatever the limit; few slices have as many rows as it takes.
    more_than = max(more_than, 0)
    slices = counted.select(F.unix_micros("v.start").alias("inicio"), "id_cliente", steps.alias("pasos"))
    busy = slices.filter(F.aggregate("pasos", F.lit(0).cast("long"), lambda n, m: n + m) > more_than)
    found = busy.select("id_cliente", F.inline(windows).alias("al", "total")).filter(F.col("total") > more_than)
    return found.select(
        F.timestamp_micros("al").alias("desde"), F.timestamp_micros(F.col("al") + length).alias("hasta"),
        "id_cliente", "total",
    )


def _micros(spark: SparkSession, interval: str) -> int:
    """The length of an interval like ``1 hour``."""
    end = F.timestamp_micros(F.lit(0)) + F.lit(interval).cast("interval")
    return spark.range(1).select(F.unix_micros(end)).first()[0]


def stateless_rules(
    tx: DataFrame, location: DataFrame, *, rules: FraudRules = DEFAULT_RULES
) -> DataFrame:
    """T4: the two rules that need no history, row by row, against the static locations.

    Meant for the rows of one micro-batch: their join is planned when they are there, so AQE
    splits a client that many of them have.
    """
    return (
        tx.join(location, "id_cliente", "left")
        .withColumn("r1_geo", is_far(rules))
        .withColumn("r4_hora", is_odd_hour(rules))
        .select("id_transaccion", "id_cliente", "fecha", "r1_geo", "r4_hora")
    )


def exact_velocity_stream(
    tx: DataFrame, *, rules: FraudRules = DEFAULT_RULES, delay: str = DELAY
) -> DataFrame:
    """T3: the instants of the exact trailing-window velocity rule, per client and slice of time.

    A client's time is cut into slices as long as the rule's window. The state of a slice is the
    times of its transactions and of those one window before it, which is all that its windows
    can reach; it is dropped once the watermark has passed the slice. With the times in order, an
    instant has more than ``max_tx`` rows in its window if the time ``max_tx`` places before it is
    inside, whatever that number is. Rows that are late within the delay change their slice.
    """
    span = rules.window_seconds
    sliced = (
        tx.withWatermark("fecha", delay)
        .groupBy(F.window("fecha", f"{2 * span} seconds", f"{span} seconds").alias("v"), "id_cliente")
        .agg(F.array_sort(F.collect_list(F.unix_micros("fecha"))).alias("micros"))
        .withColumn("propio", F.unix_micros("v.start") + span * 1_000_000)
    )
    busy = F.transform(
        "micros",
        lambda t, i: F.when(
            (t >= F.col("propio"))
            & (F.get("micros", i - rules.max_tx) > t - span * 1_000_000), t
        ),
    )
    return (
        sliced.withColumn("micros", F.array_distinct(F.array_compact(busy)))
        .filter(F.size("micros") > 0)
        .select(F.timestamp_micros("propio").alias("desde"), "id_cliente", "micros")
    )


def flagged_instants(slices: DataFrame) -> DataFrame:
    """(client, instant) pairs of :func:`exact_velocity_stream`'s current rows."""
    found = slices.select("id_cliente", F.explode("micros").alias("micros"))
    return found.select("id_cliente", F.timestamp_micros("micros").alias("fecha"))


# ── sources and sinks ───────────────────────────────────────────────────────────────────

def transactions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample's events as a stream of transactions."""
    _, columns = PROJECTIONS["transacciones_con_hora"]
    return (
        spark.readStream.schema(SAMPLE_DDL["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .selectExpr(*columns)
        .withColumn("fecha", F.col("fecha").cast("timestamp"))
    )


def batch_writer(
    output: str, job: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch, or what ``job`` makes of it, to the folder of its number.

    A batch that is run again after a failure replaces what it wrote before.
    """
    def write(rows: DataFrame, batch: int) -> None:
        made = rows if job is None else job(rows)
        made.write.mode("overwrite").parquet(os.path.join(output, f"{BATCH}={batch}"))

    return write


def run_batches(
    stream: DataFrame, folder: str, *, job: Callable[[DataFrame], DataFrame] | None = None,
    **options: str,
) -> None:
    """Runs a stream in update mode over what is there now, batch by batch into ``folder``.

    Run again on the same folder it goes on with what is new. A stream keeps the number of state
    partitions it starts with, so it is set to the cluster's parallelism. ``options`` are more
    session options of the run (dots written as ``__``).
    """
    spark = stream.sparkSession
    parallelism = str(spark.sparkContext.defaultParallelism)
    with settings(spark, spark__sql__shuffle__partitions=parallelism, **options):
        query = (
            stream.writeStream.foreachBatch(batch_writer(os.path.join(folder, "out"), job))
            .option("checkpointLocation", os.path.join(folder, "checkpoint"))
            .outputMode("update")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def written_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All rows of all batches so far, with the number of their batch; none before the first."""
    numbered = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(numbered).parquet(os.path.join(folder, "out"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], numbered)


def current_rows(
    spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str]
) -> DataFrame:
    """The newest row of each key. Combined before the shuffle, so a key that very many batches
    touched is one row per task."""
    values = [name for name in schema.names if name not in keys]
    newest = written_rows(spark, folder, schema).groupBy(*keys).agg(
        F.max_by(F.struct(*values), BATCH).alias("_v")
    )
    return newest.select(*keys, "_v.*").select(*schema.names)


def _wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _replayed(
    spark: SparkSession, sf_dir: str, name: str, job: Callable[[DataFrame], DataFrame],
    keys: Sequence[str], **options: str,
) -> DataFrame:
    # A session of its own, so that the stream's settings touch no other query.
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    folder = scratch_path(spark, name)
    stream = job(transactions_stream(own, sf_dir))
    run_batches(stream, folder, **options)
    return current_rows(spark, folder, stream.schema, keys)


def replay_channel_totals(spark: SparkSession, sf_dir: str, *, window: str = "1 hour") -> DataFrame:
    job = lambda tx: channel_totals_stream(tx, window=window)
    found = _replayed(spark, sf_dir, "totales", job, ["desde", "hasta", "canal"])
    return _wall_clock(found, "desde", "hasta")


def replay_sliding_velocity(
    spark: SparkSession, sf_dir: str, *, window: str = "1 hour", slide: str = "5 minutes"
) -> DataFrame:
    job = lambda tx: sliding_velocity_stream(tx, window=window, slide=slide)
    found = _replayed(spark, sf_dir, "deslizante", job, ["desde", "hasta", "id_cliente"], **ON_DISK)
    return _wall_clock(found, "desde", "hasta")


def replay_exact_velocity(
    spark: SparkSession, sf_dir: str, *, rules: FraudRules = DEFAULT_RULES
) -> DataFrame:
    job = lambda tx: exact_velocity_stream(tx, rules=rules)
    found = _replayed(spark, sf_dir, "velocidad", job, ["desde", "id_cliente"])
    return _wall_clock(flagged_instants(found), "fecha")


def replay_stateless_rules(
    spark: SparkSession, sf_dir: str, *, rules: FraudRules = DEFAULT_RULES
) -> DataFrame:
    location = usual_location(sample_bank(spark, sf_dir))
    judge = lambda tx: stateless_rules(tx, location, rules=rules)
    folder, stream = scratch_path(spark, "reglas"), transactions_stream(spark, sf_dir)
    run_batches(stream, folder, job=judge)
    empty = judge(spark.createDataFrame([], stream.schema))
    return _wall_clock(written_rows(spark, folder, empty.schema).drop(BATCH), "fecha")
