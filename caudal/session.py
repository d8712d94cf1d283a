"""Session settings the jobs are written for, and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE coalesces small shuffles, splits skewed partitions and turns a join whose side proves
# small at run time into a broadcast; the automatic broadcast threshold stays at Spark's
# default, so nothing large is ever broadcast by guess. Where every partition of the smaller
# side is measured below the hash-join limit, AQE also saves sorting the larger side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, app: str = "caudal", **extra: str) -> SparkSession:
    """A session with the settings above; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the session's warehouse.

    A cluster whose warehouse is a local folder is refused before anything is written: its
    executors would each write to a disk of their own. What runs leave in the folder belongs
    to the cluster's owner: queries read it lazily, so no run can remove its own tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    scheme = warehouse.partition(":")[0] if ":" in warehouse else "file"
    if scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set spark.checkpoint.dir: {warehouse} is local to each machine")
    return warehouse


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one run under the shared folder."""
    return os.path.join(shared_dir(spark), "caudal", f"{name}-{uuid.uuid4().hex}")


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Sets session options (dots written as ``__``) for the body, then puts them back."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
