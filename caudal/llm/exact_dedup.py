"""Exact duplicates by a stateful stream whose keyed state lives on disk and never expires.

A table of fingerprints (digest, stable identifier, length, content locator) is streamed into
one state entry per digest. The entry keeps the identifier and locator of the row that stays
and the number of rows seen. A digest with several rows is a hit, and hits are confirmed on
their full bytes. Only Spark's own operations are used.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from caudal.llm.common import maybe_in, stored, surely_not_in
from caudal.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, return.
WHITE = " \t\n\x0b\x0c\r"
# A representative's text meets at most about this many copies in one task.
COPIES_PER_SLICE = 2_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]
) -> DataFrame:
    """One narrow row per document; nothing of the text itself."""
    bare = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        digest(bare).alias("digest"),
        F.sha2(bare, 256).alias("text_sha256"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.input_file_name().alias("locator"),
    )


def _first() -> Column:
    """Sorts the row that stays first: longest text, then smallest id; rows without id last."""
    return F.min(
        F.struct(
            (-F.col("n_points")).alias("neg_points"),
            F.col("doc_id").isNull().alias("no_id"),
            "doc_id", "locator",
        )
    )


def keyed_state(prints: DataFrame, *, batch_bytes: int = 64 << 30) -> DataFrame:
    """Streams a stored fingerprint table through keyed state and returns the state's entries.

    The state is RocksDB on the executors' disks, with its log in the shared folder: a lost
    executor's part is rebuilt from there. There is no watermark, so entries never expire.
    ``batch_bytes`` bounds what one micro-batch reads.
    """
    # A session of its own, so that the stream's settings touch no other query.
    session = prints.sparkSession.newSession()
    partitions = prints.sparkSession.conf.get("spark.sql.shuffle.partitions")
    session.conf.set("spark.sql.shuffle.partitions", partitions)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Else each of the many small stores takes 4 MB of disk before it holds anything.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    source = os.path.dirname(prints.inputFiles()[0])
    checkpoint = scratch_path(prints.sparkSession, "dedup-state")
    stream = (
        session.readStream.schema(prints.schema).option("maxBytesPerTrigger", batch_bytes)
        .parquet(source)
        .groupBy("digest")
        .agg(_first().alias("first"), F.count("*").alias("group_size"))
    )
    query = (
        stream.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = session.read.format("statestore").load(checkpoint)
    first, size = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields)
    entries = state.select(
        F.col("key.digest").alias("digest"),
        F.col(first).getField("doc_id").alias("keep_id"),
        (-F.col(first).getField("neg_points")).alias("keep_points"),
        F.col(first).getField("locator").alias("keep_locator"),
        F.col(size).alias("group_size"),
    )
    path = scratch_path(prints.sparkSession, "dedup-entries")
    entries.write.parquet(path)
    return prints.sparkSession.read.parquet(path)


def _texts(
    docs: DataFrame, prints: DataFrame, digests: DataFrame, id_col: str, text_col: str, digest
) -> DataFrame:
    """The whole texts behind some digests. Only rows whose id may be one of theirs are hashed
    again; the join on the digest decides."""
    theirs = prints.join(digests, "digest", "left_semi")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    bare = normalised(F.col("text"))
    return maybe_in(rows, F.col("doc_id"), theirs, F.col("doc_id")).select(
        "doc_id", digest(bare).alias("digest"),
        F.char_length("text").cast("long").alias("n_points"), bare.alias("bare"),
    )


def clashing_digests(
    docs: DataFrame, prints: DataFrame, entries: DataFrame, id_col: str, text_col: str, digest
) -> DataFrame:
    """Digests whose rows differ in their full bytes from the row that stays.

    A group is cut into slices of about ``COPIES_PER_SLICE`` rows, and the kept text is sent to
    each slice once, so the size of a group sets the number of tasks and not the size of one.
    """
    hits = entries.filter(F.col("group_size") > 1)
    slices = F.ceil(F.col("group_size") / COPIES_PER_SLICE).cast("int")
    texts = _texts(docs, prints, hits, id_col, text_col, digest).join(hits, "digest")
    kept = (
        texts.filter(
            F.col("doc_id").eqNullSafe(F.col("keep_id"))
            & (F.col("n_points") == F.col("keep_points"))
        )
        .groupBy("digest", slices.alias("slices"))
        .agg(F.min("bare").alias("kept_text"))
        .select(
            "digest", "kept_text",
            F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
        )
    )
    sliced = texts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_points"), slices))
    return (
        sliced.join(kept, ["digest", "slice"])
        .filter(F.col("bare") != F.col("kept_text"))
        .select("digest").distinct()
    )


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = lambda bare: F.sha2(bare, 256),
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator: one row per row of ``docs``.

    Texts are equal when they are identical after white space is deleted. Of equal texts the
    one with the most code points stays, then the smallest doc_id; a row without an id only
    stays if all its equals have none. A NULL text counts as an empty one, and empty texts are
    equal to each other. Rows repeated with the same id, text and length are told apart: one
    of them stays. Other columns of ``docs`` are not looked at. An empty table gives no rows.

    ``digest`` only finds hits: equality is decided by the full bytes, so a digest that gives
    different texts one value changes nothing but the time taken.
    """
    prints = stored(fingerprints(docs, id_col, text_col, digest), "dedup-prints")
    if prints.isEmpty():
        return _decided(prints, _groups(prints, "digest"))
    entries = keyed_state(prints)
    clashes = stored(clashing_digests(docs, prints, entries, id_col, text_col, digest), "dedup-clashes")
    if clashes.isEmpty():
        return _decided(prints, entries)
    # One digest, different texts: for these the text itself is the key.
    good = prints.join(clashes, "digest", "left_anti")
    bad = (
        _texts(docs, prints, clashes, id_col, text_col, digest)
        .join(clashes, "digest", "left_semi")
        .withColumn("text_sha256", F.sha2("bare", 256))
        .withColumn("digest", F.col("bare"))
        .withColumn("locator", F.lit(None).cast("string"))
        .drop("bare")
    )
    return _decided(good, entries).unionByName(_decided(bad, _groups(bad, "digest")))


def _groups(rows: DataFrame, key: str) -> DataFrame:
    """What the keyed state holds, from one aggregation."""
    return rows.groupBy(key).agg(_first().alias("first"), F.count("*").alias("group_size")).select(
        key,
        F.col("first.doc_id").alias("keep_id"),
        (-F.col("first.neg_points")).alias("keep_points"),
        "group_size",
    )


def _decided(prints: DataFrame, entries: DataFrame) -> DataFrame:
    """Each row with its group's decision.

    Repeated rows travel as one row with a count, so no key gathers them; the join is an outer
    one on the left, which AQE can split where one group holds much of the table.
    """
    rows = prints.groupBy("doc_id", "digest", "n_points", "text_sha256").agg(
        F.count("*").cast("int").alias("copies"), F.min("locator").alias("locator")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (
        F.col("n_points") == F.col("keep_points")
    )
    groups = entries.select("digest", "keep_id", "keep_points", "group_size")
    return (
        rows.join(groups, "digest", "left")
        .withColumn("stays", stays)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("stays") & (F.col("copy") == 1)).alias("kept"),
            "text_sha256", "n_points", "locator",
        )
    )


def drop_exact_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one :func:`exact_duplicates` keeps.

    Rows whose id is in no group of several pass as they are; the others meet the decisions.
    """
    found = stored(exact_duplicates(docs, id_col=id_col, text_col=text_col), "dedup-decisions")
    several = found.filter(F.col("group_size") > 1)
    key = F.col(id_col).cast("long")
    alone = surely_not_in(docs, key, several, F.col("doc_id"))
    bare = normalised(F.col(text_col))
    keys = ["_sha256", "_points", "_id"]
    rows = maybe_in(docs, key, several, F.col("doc_id")).withColumns({
        "_sha256": F.sha2(bare, 256), "_id": key,
        "_points": F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
    })
    stays = found.filter("kept").select(
        F.col("text_sha256").alias("s"), F.col("n_points").alias("n"), F.col("doc_id").alias("d")
    )
    same = (F.col("_sha256") == F.col("s")) & (F.col("_points") == F.col("n"))
    chosen = rows.join(stays, same & F.col("_id").eqNullSafe(F.col("d")), "left_semi")
    # Rows repeated with the same id and text are one.
    return alone.unionByName(chosen.dropDuplicates(keys).drop(*keys))
