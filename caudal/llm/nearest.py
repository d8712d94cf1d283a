"""Approximate nearest neighbours by collision counting on single projections.

Every vector is projected on a few random lines; each projection is kept as a sorted array. A
query's window on each array is centred on its own projection. Virtual rehashing widens the
windows by growing the radius, which needs no new index, and counts in how many windows a
vector has been seen. Vectors that collide often enough are verified on their exact distance.
The search ends when the wanted number of verified vectors lies within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from caudal.llm.common import stored

NEIGHBOURS = 10
PROJECTIONS = 64
# Share of the windows a vector must fall into before it is verified. At a distance equal to
# the radius a window of WIDTH radii holds it with probability 0.83, at twice that with 0.5.
COLLISIONS = 0.8
WIDTH = 2.72
GROWTH = 1.12
# The first radius is this share of the smallest distance to a few of the segment's vectors.
PROBES = 200
FIRST = 0.7
# Vectors of one index segment and queries of one block: what a task holds at a time.
SEGMENT = 20_000
BLOCK = 2_000

_HITS = T.StructType([
    T.StructField("q", T.LongType()), T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType()),
])


def usable(vector: Column) -> Column:
    """Neither NULL nor empty nor zero, all components there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


class SortedProjections:
    """The index of one segment."""

    def __init__(self, vectors: np.ndarray, projections: int) -> None:
        self.vectors = vectors
        # The same lines for every segment and every run.
        lines = np.random.default_rng(vectors.shape[1]).standard_normal((vectors.shape[1], projections))
        self.lines = lines
        projected = vectors @ lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(projected.T, self.order, axis=1)
        self.needed = int(np.ceil(COLLISIONS * projections))

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all verified vectors, at least the k nearest found."""
        m, n = self.values.shape
        centre = query @ self.lines
        low = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre, strict=True)])
        high = low.copy()
        counts = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        found: list[np.ndarray] = []
        distances: list[np.ndarray] = []
        gap = self.vectors[:: max(1, n // PROBES)] - query
        apart = np.sqrt((gap * gap).sum(1))
        radius = FIRST * float(apart[apart > 0].min(initial=1.0))
        # Windows this wide hold every vector.
        widest = 2 * float(np.abs(self.values).max() + np.abs(centre).max())
        while True:
            width = radius * WIDTH / 2
            entered = []
            for j in range(m):
                a = min(np.searchsorted(self.values[j], centre[j] - width, "left"), low[j])
                b = max(np.searchsorted(self.values[j], centre[j] + width, "right"), high[j])
                entered += (self.order[j, a:low[j]], self.order[j, high[j]:b])
                low[j], high[j] = a, b
            counts += np.bincount(np.concatenate(entered), minlength=n)
            new = np.flatnonzero((counts >= self.needed) & ~done)
            if len(new):
                done[new] = True
                gap = self.vectors[new] - query
                found.append(new)
                distances.append(np.sqrt((gap * gap).sum(1)))
            if sum(int((d <= radius).sum()) for d in distances) >= k or done.all():
                break
            radius = radius * GROWTH if width <= widest else float("inf")
        return np.concatenate(found), np.concatenate(distances)


def _search(k: int, projections: int):
    def run(segment: pa.Table, queries: pa.Table) -> pa.Table:
        columns: list[list[np.ndarray]] = [[], [], []]
        if segment.num_rows and queries.num_rows:
            ids = segment["vec_id"].to_numpy()
            vectors = _matrix(segment["vector"])
            index = SortedProjections(vectors, projections)
            for q, query in zip(queries["q"].to_numpy(), _matrix(queries["vector"]), strict=True):
                places, distances = index.nearest(query, min(k, len(ids)))
                best = np.lexsort((ids[places], distances))[:k]
                columns[0].append(np.full(len(best), q))
                columns[1].append(ids[places[best]])
                columns[2].append(distances[best])
        made = [np.concatenate(c) if c else np.empty(0) for c in columns]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table(
            [pa.array(c.astype(t), k_) for c, t, k_ in zip(made, ("i8", "i8", "f8"), kinds, strict=True)],
            names=_HITS.names,
        )

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    return flat.reshape(len(column), -1).astype(np.float64)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, *, k: int = NEIGHBOURS, projections: int = PROJECTIONS,
    id_col: str = "vec_id", vector_col: str = "embedding", segment: int = SEGMENT,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row that ``is_query`` holds for.

    All other rows are candidates; distances are Euclidean, in double precision on the original
    vectors; ties go to the smaller id. With fewer candidates than ``k`` all are returned.
    Vectors that are NULL, empty, zero, or have NULL or non-finite components take no part, nor
    do rows without an id. Vectors of different lengths are never compared. Rows repeated with
    the same id and vector count once. Other columns are not looked at; an empty table gives no
    rows.

    Equal vectors are searched for once, and only the k + 1 smallest ids of each are kept as
    candidates, as no query can return more: a vector that a third of all rows hold is a few
    rows. Every segment of candidates meets every block of queries, never all with all at once.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"),
        is_query.alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    candidates = (
        rows.select("vec_id", "vector").distinct()
        .withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= k + 1)
    )
    candidates = stored(candidates.select("vec_id", "vector", F.size("vector").alias("n")), "candidates")
    asked = rows.filter("asks").select("vec_id", "vector").distinct()
    queries = stored(
        asked.groupBy("vector").agg(F.min("vec_id").alias("q")).withColumn("n", F.size("vector")),
        "queries",
    )
    segments = max(1, -(-candidates.count() // segment))
    blocks = max(1, -(-queries.count() // block))
    part = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count))
    every = lambda count: F.explode(F.expr(f"sequence(0L, {count - 1}L)"))
    indexed = candidates.withColumn("s", part("vec_id", segments)).withColumn("b", every(blocks))
    blocked = queries.withColumn("b", part("q", blocks)).withColumn("s", every(segments))
    key = ["n", "s", "b"]
    # One more than wanted, as a query may find itself.
    hits = indexed.groupBy(*key).cogroup(blocked.groupBy(*key)).applyInArrow(
        _search(k + 1, projections), _HITS
    )
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    best = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    answers = asked.withColumnRenamed("vec_id", "query_id").join(queries, "vector").join(
        best.select("q", "vec_id", "score"), "q"
    ).filter("query_id <> vec_id")
    ranked = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
