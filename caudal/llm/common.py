"""What several of the operators need: stored intermediate tables and bounded pre-filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caudal.session import scratch_path

# A pre-filter broadcasts at most this many 8-byte bucket numbers, whatever the input.
BUCKETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage: executors lost later cost no recomputation, and what Python made
    is made once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _by_bucket(df: DataFrame, key: Column, keys: DataFrame, of: Column, how: str) -> DataFrame:
    taken = F.broadcast(keys.select(_bucket(of).alias("_bucket")).distinct())
    return df.withColumn("_bucket", _bucket(key)).join(taken, "_bucket", how).drop("_bucket")


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """The rows of ``df`` whose key may be in ``keys``: all that are and few that are not.

    A semi join on a hash bucket. The broadcast has at most ``BUCKETS`` numbers, so it is
    bounded at any input; when every bucket is taken, all rows pass and the exact join that
    must follow does the work. It only keeps rows that can't match out of that join's shuffle.
    """
    return _by_bucket(df, key, keys, of, "left_semi")


def surely_not_in(df: DataFrame, key: Column, keys: DataFrame, of: Column) -> DataFrame:
    """The other rows: those whose key cannot be in ``keys``."""
    return _by_bucket(df, key, keys, of, "left_anti")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped``; rows without an id stay.

    Only rows that may be dropped travel to the join.
    """
    ids, key = dropped.select(F.col("doc_id").alias("_dropped")), F.col(id_col)
    doubtful = maybe_in(docs, key, ids, F.col("_dropped"))
    return surely_not_in(docs, key, ids, F.col("_dropped")).unionByName(
        doubtful.join(ids.distinct(), key.cast("long") == F.col("_dropped"), "left_anti")
    )
