"""A Merkle manifest of a table: a persistent tree whose versions copy one path each.

Every row is a leaf. The leaves of a group (a language) ascend by id; every ``ARITY`` neighbours
become the digest of their digests, until one is left, the group's root; the roots of all groups
make a last tree in the same way.

The tree is built upwards in aligned blocks of ``ARITY ** HEIGHT`` nodes: a block is one group of a
shuffle, whatever share of the table its language has, and its topmost nodes are the leaves of the
next, much smaller table. Then paths go down: a block learns the steps from its top to the root,
each with the digests to the left and to the right, which all its nodes share.

A changed leaf is a version of the tree. It shares every node that it does not touch and copies
the ancestors only: inside its aligned block first, then along the block's shared steps, so the
versions of the upper levels are spread over as many tasks as there are blocks of leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caudal.llm.common import stored

ARITY = 8
# Levels within one block: 4,096 nodes.
HEIGHT = 4

Step = tuple[str, str]
_STEPS = "array<struct<l:string,r:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """The levels above neighbouring nodes: to their one root if they are a whole tree of ``n``
    nodes, else ``height`` levels."""

    def __init__(self, nodes: list[str], n: int, height: int) -> None:
        whole = n <= ARITY ** height
        self.levels = [nodes]
        while (len(self.levels[-1]) > 1) if whole else (len(self.levels) <= height):
            below = self.levels[-1]
            runs = range(0, len(below), ARITY)
            self.levels.append([digest("".join(below[i:i + ARITY])) for i in runs])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def steps(self, place: int) -> list[Step]:
        """From a node up to the block's top: what lies to its left and right in each run."""
        made = []
        for level in self.levels[:-1]:
            first = place - place % ARITY
            made.append(("".join(level[first:place]), "".join(level[place + 1:first + ARITY])))
            place //= ARITY
        return made


def copied_path(leaf: str, steps: list[Step]) -> list[str]:
    """A version's own nodes, from the changed leaf to its root; all others are shared."""
    path = [leaf]
    for left, right in steps:
        path.append(digest(left + path[-1] + right))
    return path


def _tops(height: int, table: pa.Table) -> pa.Table:
    """One aligned block of nodes to its topmost node."""
    rows = sorted(zip(table["place"].to_pylist(), table["node"].to_pylist(), strict=True))
    block = Block([node for _, node in rows], table["n"][0].as_py(), height)
    width = ARITY ** height
    # n: the nodes of the next stage, one per block of the tree.
    return pa.table({
        "tree": [table["tree"][0].as_py()], "place": [rows[0][0] // width], "node": [block.top],
        "n": [-(-table["n"][0].as_py() // width)],
    })


def _paths(height: int, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Steps to the root of every node of a block, from those of the block's top."""
    rows = sorted(zip(nodes["place"].to_pylist(), nodes["node"].to_pylist(), strict=True))
    tree = nodes["tree"][0].as_py()
    block = Block([node for _, node in rows], nodes["n"][0].as_py(), height)
    shared = [(s["l"], s["r"]) for s in above["steps"][0].as_py()]
    made = [[{"l": a, "r": b} for a, b in block.steps(i) + shared] for i in range(len(rows))]
    steps = pa.array(made, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))
    return pa.table({"tree": pa.array([tree] * len(rows)), "place": [p for p, _ in rows], "steps": steps})


def _proofs(height: int, leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and version of every leaf of a block."""
    rows = sorted(leaves.to_pylist(), key=lambda r: r["place"])
    block = Block([r["leaf"] for r in rows], rows[0]["n"], height)
    top = above.to_pylist()[0]
    shared = [(s["l"], s["r"]) for s in top["steps"]]
    below = len(block.levels) - 1
    proofs, versions = [], []
    for i, row in enumerate(rows):
        own = block.steps(i)
        steps = own + shared
        proofs.append(digest("".join(left + right for left, right in steps)))
        changed = row["changed"]
        if changed is None or changed == row["leaf"]:
            # Nothing is copied; the proof is followed nevertheless.
            versions.append(copied_path(row["leaf"], steps)[-1:])
        else:
            inside = copied_path(changed, own)
            versions.append(inside[:below] + copied_path(inside[-1], shared))
    return pa.table({
        "id": pa.array([r["id"] for r in rows], leaves.schema.field("id").type),
        "leaf": [r["leaf"] for r in rows],
        "subroot": [top["subroot"]] * len(rows),
        "proof_sha256": proofs,
        "path": pa.array(versions, pa.list_(pa.string())),
    })


def _numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``: their number from 0 within the groups ``by``, in ``order``.

    Rows are dealt by ranges of (group, order), so a group of any size is many tasks; the rows
    before a range come from the counts of (range, group).
    """
    dealt = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    dealt = stored(dealt, "merkle-order")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    counts = counts.select("_range", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range", *by).orderBy(*order)
    placed = dealt.withColumn("_at", F.row_number().over(within) - 1).alias("d")
    same = F.col("d._range") == F.col("c._range")
    for name in by:
        same &= F.col(f"d.{name}").eqNullSafe(F.col(f"c.{name}"))
    return placed.join(counts.alias("c"), same, "left").select(
        *(f"d.{name}" for name in rows.columns), (F.col("_before") + F.col("_at")).alias("place")
    )


class _Forest:
    """Trees built upwards from ``nodes`` (tree, place, node, n), block by block."""

    def __init__(self, nodes: DataFrame, height: int) -> None:
        self.height = height
        self.stages = [nodes]
        while not nodes.filter("n > 1").isEmpty():
            tops = nodes.groupBy("tree", self.block()).applyInArrow(
                self.task(_tops), "tree long, place long, node string, n long"
            )
            nodes = stored(tops, "merkle-nodes")
            self.stages.append(nodes)

    def task(self, step: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
        """``step`` for blocks of this height, as a function of the tables alone."""
        height = self.height
        if step is _tops:
            return lambda nodes: step(height, nodes)
        return lambda nodes, above: step(height, nodes, above)

    def block(self) -> Column:
        return F.expr(f"place div {ARITY ** self.height}").alias("block")

    def down(self, nodes: DataFrame, paths: DataFrame, step: Callable[..., pa.Table], made: str) -> DataFrame:
        """``step`` on every block of ``nodes`` with the path of its top."""
        blocks = nodes.groupBy("tree", self.block()).cogroup(paths.groupBy("tree", "place"))
        return blocks.applyInArrow(self.task(step), made)

    def paths(self, above: DataFrame, down_to: int) -> DataFrame:
        """(tree, place, steps) of the nodes of stage ``down_to``; ``above`` (tree, steps) has
        those of the roots."""
        paths = above.select("tree", F.lit(0).cast("long").alias("place"), "steps")
        for nodes in reversed(self.stages[down_to:-1]):
            made = self.down(nodes, paths, _paths, f"tree long, place long, steps {_STEPS}")
            paths = stored(made, "merkle-paths")
        return paths


def leaf_digest(*fields: Column) -> Column:
    """A row as a leaf: each field as its UTF-8 byte count, a colon and the value, NULL as a dash."""
    texts = [f.cast("string") for f in fields]
    parts = [
        F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def manifest(
    rows: DataFrame, *, id_col: str, group_col: str, leaf: Column, changed: Column,
    height: int = HEIGHT,
) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, path: one row per row, with the tree of all rows.

    ``leaf`` and ``changed`` are digests in hex; ``changed`` is NULL or equal to ``leaf`` for rows
    that were not tampered with. ``subroot`` is the root of the row's group, ``root`` that of all
    groups, which ascend bytewise with the NULL group first. ``proof_sha256`` digests the row's
    siblings, from its own level to the root, left to right. ``path`` holds the nodes that the
    row's version copies, from the changed leaf's to the new root, and only the recomputed root for
    a row that did not change: its last element is the root that the proof leads to.

    Rows of the same id are ordered by their leaves; rows without an id come first. NULL fields
    are dashes, an empty text is ``0:``. Columns other than those in the arguments are not looked
    at; an empty table gives no rows. Texts are read once; then only digests are moved.
    """
    made = rows.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("part"), leaf.alias("leaf"),
        changed.alias("changed"),
    )
    placed = _numbered(made, ["part"], ["id", "leaf"])
    placed = stored(placed, "merkle-leaves")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    # Trees are numbered in the order of their groups.
    trees = stored(_numbered(sizes.withColumn("all", F.lit(0)), ["all"], ["part"]), "merkle-trees")
    trees = trees.select("part", "n", F.col("place").alias("tree"))
    leaves = placed.alias("l").join(trees.alias("t"), F.col("l.part").eqNullSafe(F.col("t.part"))).select(
        "tree", "place", "n", "id", "leaf", "changed"
    )
    leaves = stored(leaves, "merkle-leaves")
    groups = _Forest(leaves.select("tree", "place", F.col("leaf").alias("node"), "n"), height)
    subroots = groups.stages[-1].select("tree", F.col("node").alias("subroot"))
    # The groups' roots are the leaves of one more tree.
    whole = _Forest(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
        F.col("subroot").alias("node"), F.lit(trees.count()).alias("n"),
    ), height)
    last = whole.stages[-1].first()
    over = whole.paths(whole.stages[-1].select("tree", F.from_json(F.lit("[]"), _STEPS).alias("steps")), 0)
    over = over.select(F.col("place").alias("tree"), "steps")
    # Every block of leaves shares the steps from its top to the root.
    above = groups.paths(over, 1).join(subroots, "tree")
    kind = rows.schema[id_col].dataType.simpleString()
    proofs = groups.down(
        leaves, above, _proofs,
        f"id {kind}, leaf string, subroot string, proof_sha256 string, path array<string>",
    )
    return proofs.select(
        F.col("id").alias(id_col), "leaf", "subroot", F.lit(last["node"] if last else None).alias("root"),
        "proof_sha256", "path",
    )
