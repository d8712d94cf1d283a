"""Near duplicates among embeddings by cross-polytope hashing.

A vector is rotated by sign flips and Hadamard transforms, three times each, and hashed to the
axis it lies closest to, with its direction. ``ROTATIONS`` such axes make a code. Probing places a
vector under the ``PROBES`` codes that it misses least, in each of ``TABLES`` tables; vectors that
share a code are a candidate pair, and a candidate counts if its cosine, in double precision on the
original vectors, reaches the threshold.

Two vectors at a cosine of 0.9 share a code with a probability of 0.62 in a table, so one pair in
6,000 at the very threshold goes unseen with nine tables, and fewer at higher cosines. Two
unrelated ones do with about one in a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caudal.llm.common import stored
from caudal.llm.graph import components
from caudal.llm.nearest import usable

COSINE = 0.9
ROTATIONS = 3
TABLES = 9
PROBES = 6
# Axes looked at for each rotation of a code.
AXES = 4
# A code that more vectors share is dealt over pairs of slices of about this many.
SLICE = 2048
# Vectors under one code that are compared pair by pair.
FEW = 32
# Rows that a task takes, rows of a product that it holds at a time, and pairs.
TASK_ROWS = 8192
ROWS = 512
PAIRS = 1 << 15
SEED = 20
# More than a cosine's rounding error.
ROUNDING = 1e-9


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of every row, by additions only: a row's result does not depend on others."""
    rows, size = x.shape
    half = 1
    while half < size:
        x = x.reshape(rows, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, size)
        half *= 2
    return x


def codes_of(
    vectors: np.ndarray, rotations: int = ROTATIONS, tables: int = TABLES, probes: int = PROBES
) -> np.ndarray:
    """[vector, table, probe]: the codes, different in each table, of rows of equal length."""
    n, length = vectors.shape
    size = 1 << max(1, (length - 1).bit_length())
    # Scaling changes no code and keeps sums finite.
    x = np.zeros((n, size))
    x[:, :length] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    rng = np.random.default_rng([SEED, size])
    axes = min(AXES, size)
    out = np.empty((n, tables, min(probes, axes ** rotations)), np.int64)
    for table in range(tables):
        score, code = np.zeros((n, 1)), np.full((n, 1), table, np.int64)
        for _ in range(rotations):
            y = x
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size)) / np.sqrt(size)
            near = np.argpartition(-np.abs(y), axes - 1, axis=1)[:, :axes]
            at = np.take_along_axis(y, near, axis=1)
            score = (score[:, :, None] + np.abs(at)[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * size) + (2 * near + (at < 0))[:, None, :]).reshape(n, -1)
        best = np.argpartition(-score, out.shape[2] - 1, axis=1)[:, :out.shape[2]]
        out[:, table] = np.take_along_axis(code, best, axis=1)
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _coded(rotations: int, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                rows = pa.Table.from_batches([batch]).filter(pa.array(lengths == length))
                codes = codes_of(_matrix(rows["vector"]), rotations, tables, probes)
                codes = codes.reshape(len(codes), -1)
                each = codes.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(rows["rep"].to_numpy(), each)),
                        pa.array(np.repeat(rows["mark"].to_numpy(), each)),
                        pa.array(np.full(codes.size, length, np.int32)),
                        pa.array(codes.ravel()),
                    ],
                    names=["rep", "mark", "n", "code"],
                )

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether ``code`` is the first that the rows of codes ``a`` and ``b`` share."""
    first = np.ones(len(a), bool)
    left = np.arange(len(a))
    for table in range(a.shape[1]):
        same = a[left, table][:, :, None] == b[left, table][:, None, :]
        shared = same.any(axis=(1, 2))
        lowest = np.where(same.any(axis=2), a[left, table], np.iinfo(np.int64).max).min(axis=1)
        first[left[shared]] = lowest[shared] == code[left[shared]]
        left = left[~shared]
        if not len(left):
            break
    return first


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each of some groups of neighbouring rows, in bounded portions."""
    row = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes, strict=True)] or [[]]).astype(np.int64)
    behind = np.repeat(starts + sizes, sizes) - row - 1
    ends = np.cumsum(behind)
    first = 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - behind[first] + PAIRS, "right")))
        n = behind[first:last]
        a = np.repeat(row[first:last], n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        first = last


class _Vectors:
    """Rows of vectors that a task compares."""

    def __init__(self, vectors: np.ndarray, cosine: float) -> None:
        # Powers of two: sums stay finite, and no digit changes.
        self.scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
        self.norms = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        self.cosine = cosine

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        products = (self.scaled[a] * self.scaled[b]).sum(axis=1)
        return products / (self.norms[a] * self.norms[b]) >= self.cosine

    def links(self, rows: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs of ``rows`` with ``others``, or within them if both are the same."""
        for start in range(0, len(rows), ROWS):
            left = rows[start:start + ROWS]
            cosines = self.scaled[left] @ self.scaled[others].T
            cosines /= self.norms[left, None] * self.norms[others]
            # A product of matrices rounds by the place of a row: pairs so close are computed alone.
            x, y = np.nonzero(cosines >= self.cosine - ROUNDING)
            if rows is others:
                x, y = x[start + x < y], y[start + x < y]
            for at in range(0, len(x), PAIRS):
                i, j = x[at:at + PAIRS], y[at:at + PAIRS]
                sure = cosines[i, j] >= self.cosine + ROUNDING
                a, b = left[i], others[j]
                sure[~sure] = self.linked(a[~sure], b[~sure])
                yield a[sure], b[sure]


def _linked(cosine: float, rotations: int, tables: int, probes: int):
    """The links within some codes, or between two slices of one.

    Each pair is counted under the first code it shares only. Of the links, every vector keeps
    one to the smallest id that it is connected with here: enough to connect all.
    """
    def run(members: pa.Table) -> pa.Table:
        members = members.sort_by([(c, "ascending") for c in ("code", "low", "high", "part", "rep")])
        code, low, high, part, reps, marks, sizes = (
            members[c].to_numpy() for c in ("code", "low", "high", "part", "rep", "mark", "size")
        )
        matrix = _matrix(members["vector"])
        vectors = _Vectors(matrix, cosine)
        # A vector is in several rows here; nodes are numbered by id.
        nodes = np.rec.fromarrays([reps, marks])
        _, first_row, node = np.unique(nodes, return_index=True, return_inverse=True)
        counts = np.zeros(len(first_row), np.int64)
        label = np.arange(len(first_row))
        codes = np.empty((len(first_row), tables, codes_of(matrix[:1], rotations, tables, probes).shape[2]), np.int64)
        coded = np.zeros(len(first_row), bool)

        def count(x: np.ndarray, y: np.ndarray) -> None:
            a, b = node[x], node[y]
            new = np.unique(np.concatenate([a, b]))
            new = new[~coded[new]]
            if len(new):
                codes[new] = codes_of(matrix[first_row[new]], rotations, tables, probes)
                coded[new] = True
            first = _first_shared(codes[a], codes[b], code[x])
            np.add.at(counts, a[first], sizes[y[first]])
            np.add.at(counts, b[first], sizes[x[first]])
            while True:
                p, q = label[a], label[b]
                if (p == q).all():
                    break
                np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
                while (label[label] != label).any():
                    label[:] = label[label]

        borders = np.flatnonzero(
            (code[1:] != code[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        ) + 1
        starts = np.concatenate([[0], borders])
        held = np.diff(np.concatenate([starts, [len(code)]]))
        # Few vectors: pair by pair, for many codes at once. Many: by products of matrices.
        few = (held <= FEW) & (low[starts] == high[starts])
        for a, b in _pairs(starts[few], held[few]):
            near = vectors.linked(a, b)
            if near.any():
                count(a[near], b[near])
        for start, n in zip(starts[~few], held[~few], strict=True):
            rows = np.arange(start, start + n)
            others = rows
            if low[start] != high[start]:
                rows, others = rows[part[rows] == low[start]], rows[part[rows] == high[start]]
            for a, b in vectors.links(rows, others):
                count(a, b)
        partner = reps[first_row][label]
        own, mark = reps[first_row], marks[first_row]
        some = (counts > 0) | (partner != own)
        return pa.table([own[some], mark[some], counts[some], partner[some]], names=["rep", "mark", "links", "partner"])

    return run


def near_embeddings(
    vectors: DataFrame, *, cosine: float = COSINE, id_col: str = "vec_id",
    vector_col: str = "embedding", rotations: int = ROTATIONS, tables: int = TABLES,
    probes: int = PROBES, slice_size: int = SLICE,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every different (id, vector).

    Links join vectors whose cosine is at least ``cosine``; none below it. ``n_links`` counts the
    other rows that a vector is linked with, ``component_id`` is the smallest id that links reach
    and ``kept`` tells whether that is the row's own. Rows with the same id and vector count once;
    an id with several vectors is one node of the graph and one row for each of them. Vectors that
    are NULL, empty, zero or hold NULL or non-finite components link with nothing, as do rows
    without an id, which come back as they are (component NULL, not kept); vectors of different
    lengths are never compared. Other columns are not looked at; an empty table gives no rows.

    Equal vectors are one candidate with a size, so copies make no pairs. Codes travel as
    numbers first; only under codes that several vectors share do vectors follow, and a code with
    more than ``slice_size`` of them is dealt over pairs of slices, so no task holds more than two.
    With more vectors, raise ``rotations``: each one divides what unrelated vectors share by about
    ``2 * length``, and ``tables`` has to make up for the recall.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")
    ).distinct()
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    marked = rows.withColumn("vector", F.when(good, F.col("vector")))
    marked = stored(marked.withColumn("mark", F.xxhash64("vector")), "vectors")
    known = marked.filter(F.col("vector").isNotNull())
    classes = known.groupBy("mark", "vector").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("size")
    ).withColumn("n", F.size("vector"))
    classes = stored(classes, "classes")
    coded = classes.select("rep", "mark", "n", "vector").mapInArrow(
        _coded(rotations, tables, probes), "rep long, mark long, n int, code long"
    )
    coded = stored(coded, "codes")
    shared = coded.groupBy("n", "code").agg(F.count("*").alias("held")).filter("held > 1")
    slices = F.ceil(F.col("held") / slice_size).cast("int")
    part = F.pmod(F.xxhash64("rep", "mark"), F.col("slices")).cast("int")
    members = (
        coded.join(shared.select("n", "code", slices.alias("slices")), ["n", "code"])
        .withColumn("part", part)
        # Slice 3 of 5 meets 0, 1, 2, itself and 4.
        .withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
        .select(
            "n", "code", "rep", "mark", "part",
            F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        )
    )
    members = stored(members, "members")
    tasks = members.count() // TASK_ROWS + 1
    task = F.pmod(F.xxhash64("n", "code", "low", "high"), F.lit(tasks)).alias("task")
    found = members.join(classes.select("rep", "mark", "size", "vector"), ["rep", "mark"]).groupBy("n", task).applyInArrow(
        _linked(cosine, rotations, tables, probes), "rep long, mark long, links long, partner long"
    )
    found = stored(found, "links")
    counts = found.groupBy("rep", "mark").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("rep").alias("a"), F.col("partner").alias("b"))
    # Ids with several vectors tie these together.
    named = marked.join(
        classes.select("mark", "vector", "rep", "size"), ["mark", "vector"], "left"
    ).join(counts, ["rep", "mark"], "left")
    named = stored(named.select("vec_id", "rep", "size", "links"), "named")
    tied = named.filter("vec_id <> rep").join(named.filter("vec_id = rep").select("vec_id").distinct(), "vec_id", "left_semi")
    tied = tied.select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    reached = components(edges.unionByName(tied))
    node = F.col("rep") == F.col("node")
    return named.join(reached, node, "left").select(
        "vec_id",
        F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "rep", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
