"""Near duplicates by bottom-k sketches of one hash function.

1. Documents with the same shingle set form a class; its smallest doc_id stands for it.
2. A class's sketch is the k smallest hashes of its set. Sketch values that only one class
   holds cannot make a pair. Of the others, ordered by how many classes hold them, a class
   enters only its rarest into the inverted lists: if two sketches share ``need`` values, they
   meet in the lists when each leaves out its ``need - 1`` most frequent ones. So a passage
   that very many documents share does not make lists of them.
3. A list is not expanded into its pairs. First all members are held against one pivot, the
   class whose values are the most common, and links found this way merge members into
   components; lists with one component are done. What is left is joined within the lists of a
   pivot: only for members of different components, and the join itself estimates the overlap
   from small samples of both sets and then compares the full sets, so that it gives nothing
   but links. No pair that could still join two components is left out.
4. Pairs with a pivot pass the estimate from the union of both sketches, then the full sets
   are compared.

A pair at the threshold has at least ``need`` common values among the k smallest of its union
but for a chance of about one in a million (the count is hypergeometric with mean 0.8 k).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from caudal.llm import graph
from caudal.llm.common import maybe_in, stored
from caudal.llm.graph import components, join_dealt
from caudal.llm.shingles import digest, mix, shingle_sets, signed

WORDS = 5
SIMILAR_PERCENT = 80
SKETCH = 64
# Members of one list that a task takes at a time: against the list's pivot, or against as many
# others of the list.
SLICE = 400
# How many standard deviations below its mean a count of common values may fall.
SLACK = 4.75

_LONG = T.LongType()
_CLASS = [T.StructField(n, _LONG) for n in ("doc_id", "n_shingles", "d1", "d2")]
_SKETCHES = T.StructType([*_CLASS, T.StructField("sketch", T.ArrayType(_LONG, False))])
# A set's sample: the smallest hash of each of 128 buckets as 4 bits, 16 to a number.
_SAMPLE = [f"sample_{i}" for i in range(8)]
_SETS = T.StructType([
    *_SKETCHES.fields, *[T.StructField(n, _LONG) for n in _SAMPLE],
    T.StructField("shingles", T.ArrayType(_LONG, False)),
])


def _sketcher(words: int, k: int, with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows: list[tuple] = []
            size = 0
            for doc_id, found in zip(
                batch.column(0).to_pylist(), shingle_sets(texts, words), strict=True
            ):
                rows.append((doc_id, len(found), *digest(found), signed(found[:k])))
                if with_sets:
                    rows[-1] += (*sample(found), signed(found))
                    size += len(found)
                if size > 1 << 20:
                    yield _batch(rows, with_sets)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, with_sets)

    return run


def _batch(rows: list[tuple], with_sets: bool) -> pa.RecordBatch:
    lists = pa.list_(pa.field("element", pa.int64(), False))
    kinds = [pa.int64()] * 4 + [lists]
    if with_sets:
        kinds += [pa.int64()] * len(_SAMPLE) + [lists]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=(_SETS if with_sets else _SKETCHES).names,
    )


def sample(found: np.ndarray) -> list[int]:
    """A code from 1 to 15 of each bucket's smallest hash, 0 for an empty bucket."""
    scrambled = mix(found)
    buckets, first = np.unique(scrambled >> np.uint64(57), return_index=True)
    codes = np.zeros(128, np.uint64)
    codes[buckets] = scrambled[first] % np.uint64(15) + np.uint64(1)
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return (codes.reshape(8, 16) << shifts).sum(1, dtype=np.uint64).view(np.int64).tolist()


def needed(n: Column, k: int, percent: int) -> Column:
    """Common sketch values that a set of ``n`` shingles shares with any set linked to it."""
    share = percent / 100
    large = int(k * share - SLACK * (k * share * (1 - share)) ** 0.5)
    # Partners of such small sets fit into a sketch as well, so the count is exact.
    whole = F.ceil(n * percent / 100)
    return F.when(n <= int(k * share), whole).otherwise(F.lit(large)).cast("int")


def inverted_lists(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, node, central): each class under its rarest shared sketch values.

    ``central`` adds up how many classes hold each of its values.
    """
    postings = classes.select(
        "node", needed(F.col("n_shingles"), k, percent).alias("need"),
        F.explode("sketch").alias("value"),
    )
    held = postings.groupBy("value").agg(F.count("*").cast("int").alias("holders"))
    shared = postings.join(held.filter("holders > 1"), "value")
    # At most k values a class.
    of_class = shared.groupBy("node").agg(
        F.array_sort(F.collect_set(F.struct("holders", "value"))).alias("values"),
        F.min("need").alias("need"),
    )
    kept = F.size("values") - F.col("need") + 1
    return (
        of_class.filter(kept > 0)
        .withColumn(
            "central",
            F.aggregate("values", F.lit(0).cast("long"), lambda n, v: n + v["holders"]),
        )
        .select("node", "central", F.explode(F.slice("values", F.lit(1), kept)).alias("entry"))
        .select(F.col("entry.value").alias("value"), "node", "central")
    )


def _both_sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (pivot, slice, node) with columns of both sets, ``…_p`` and ``…_n``.

    A pivot is in all pairs of its lists. Its set goes to each slice that it has, once, so that
    no task meets more of its pairs than a slice holds.
    """
    side = lambda end, mark: sets.select(
        F.col("node").alias(end), *[F.col(c).alias(f"{c}_{mark}") for c in columns]
    )
    slices = pairs.select("pivot", "slice").distinct().join(side("pivot", "p"), "pivot")
    return pairs.join(side("node", "n"), "node").join(slices, ["pivot", "slice"])


def confirmed(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b): the pairs that pass the estimate and whose full sets are similar enough."""
    pairs = stored(pairs, "pivot-pairs")
    seen = _both_sides(pairs, sets, ["n_shingles", "sketch"])
    few, many = F.least("n_shingles_p", "n_shingles_n"), F.greatest("n_shingles_p", "n_shingles_n")
    # Sketches are sorted, so the union's k smallest are a merge and a cut.
    low = F.slice(F.array_sort(F.array_union("sketch_p", "sketch_n")), 1, k)
    common = F.size(F.array_intersect(low, F.array_intersect("sketch_p", "sketch_n")))
    union = F.size(low)
    share = percent / 100
    enough = union * share - SLACK * F.sqrt(union * share * (1 - share)) - 1
    likely = stored(
        seen.filter((100 * few >= percent * many) & (common >= enough)).select("pivot", "slice", "node"),
        "likely",
    )
    full = _both_sides(likely, sets, ["shingles"])
    both = F.size(F.array_intersect("shingles_p", "shingles_n")).cast("long")
    either = F.size("shingles_p") + F.size("shingles_n") - both
    ends = F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    return stored(full.filter(100 * both >= percent * either).select(*ends).distinct(), "links")


def by_pivot(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(pivot, pivot_label, node, label, slice) of the lists that hold several components.

    The pivot is the list's most central class. Lists of one pivot become one: copies of a
    text share many lists, and these have the same pivot. ``slice`` deals the members of a
    list over slices of about ``SLICE``.
    """
    marked = lists.withColumn("label", F.col("node"))
    if labels is not None:
        marked = lists.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    best = F.max(F.struct("central", -F.col("node"), "label"))
    several = (
        marked.groupBy("value")
        .agg(
            F.min("label").alias("low"), F.max("label").alias("high"), best.alias("p"),
            F.ceil(F.count("*") / SLICE).alias("slices"),
        )
        .filter("low < high")
        .select("value", (-F.col("p.col2")).alias("pivot"), F.col("p.label").alias("pivot_label"), "slices")
    )
    # Where a node meets the pivot in several lists, one list's slice will do.
    of_list = F.pmod(F.xxhash64("node"), F.col("slices"))
    return marked.join(several, "value").groupBy("pivot", "pivot_label", "node", "label").agg(
        F.max(of_list).alias("slice")
    )


def pivot_pairs(entries: DataFrame) -> DataFrame:
    """(pivot, slice, node) of the members that no link joins to their pivot yet."""
    met = entries.filter(F.col("label") != F.col("pivot_label"))
    return met.select("pivot", "slice", "node")


def _maybe_similar(percent: int) -> Column:
    """Whether the samples of both sets allow the wanted similarity.

    The filled buckets' hashes are drawn from the union without replacement; those that agree
    are its common members, and a few more whose 4 bits agree by chance.
    """
    ones = F.lit(0x1111111111111111)
    some = lambda x: (
        x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))
        .bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(ones)
    )
    drawn, agree = F.lit(0), F.lit(0)
    for name in _SAMPLE:
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        drawn = drawn + F.bit_count(some(a.bitwiseOR(b)))
        agree = agree + F.bit_count(some(a).bitwiseAND(F.bitwise_not(some(a.bitwiseXOR(b)))))
    share = percent / 100
    union = (F.col("n_shingles_a") + F.col("n_shingles_b")) / (1 + share)
    spread = drawn * share * (1 - share) * F.greatest(1 - drawn / union, F.lit(0.0))
    return agree >= drawn * share - SLACK * F.sqrt(spread) - 1


def remaining_links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components within the lists of a pivot.

    The members of a pivot are dealt over slices of about ``SLICE``, and each two slices meet in a
    cell of their own. A member is sent once per slice and no task compares more than a cell, so
    a large list is as many tasks as it has cells.
    """
    size = entries.groupBy("pivot").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    full = entries.select("pivot", "node", "label").join(size, "pivot").join(
        sets.select("node", "n_shingles", *_SAMPLE, "shingles"), "node"
    )
    full = full.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    to_row = F.explode(F.sequence(F.col("own"), F.col("slices") - 1))
    to_column = F.explode(F.sequence(F.lit(0), F.col("own")))
    ends = [
        full.withColumn("other", cells).select(
            F.col("pivot").alias(f"pivot_{end}"), low.alias(f"low_{end}"), high.alias(f"high_{end}"),
            *[F.col(c).alias(f"{c}_{end}") for c in ("node", "label", "n_shingles", *_SAMPLE, "shingles")],
        )
        for end, cells, low, high in (
            ("a", to_row, F.col("own"), F.col("other")), ("b", to_column, F.col("other"), F.col("own"))
        )
    ]
    few, many = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    either = F.col("n_shingles_a") + F.col("n_shingles_b") - both
    pairs = ends[0].join(
        ends[1],
        (F.col("pivot_a") == F.col("pivot_b")) & (F.col("low_a") == F.col("low_b"))
        & (F.col("high_a") == F.col("high_b"))
        # Within one slice each pair once.
        & ((F.col("low_a") < F.col("high_a")) | (F.col("node_a") < F.col("node_b")))
        & (F.col("label_a") != F.col("label_b")) & (100 * few >= percent * many)
        & _maybe_similar(percent) & (100 * both >= percent * either),
    )
    found = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    return stored(found.distinct(), "links")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of the components ``labels`` joined by more links (a, b).

    Only the labels at the ends of the new links make a graph again; a node without a label is
    its own.
    """
    n_links = links.count()
    if not n_links:
        return labels
    ends = links.select("a", "b")
    for end, by in (("a", "b"), ("b", "a")):
        known = labels.select(F.col("node").alias(end), "component")
        ends = join_dealt(ends, end, by, known, n_links // graph.SLICE, "left")
        ends = ends.select(F.coalesce("component", end).alias(end), by).distinct()
    further = components(ends, split_hubs=True).withColumnRenamed("component", "_to")
    of_labels = further.withColumnRenamed("node", "component")
    old = join_dealt(labels, "component", "node", of_labels, labels.count() // graph.SLICE, "left")
    new = further.join(labels, "node", "left_anti").select("node", F.col("_to").alias("component"))
    return old.select("node", F.coalesce("_to", "component").alias("component")).unionByName(new)


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, percent: int = SIMILAR_PERCENT, k: int = SKETCH,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its
    distinct shingles of ``words`` words, or the whole text as one if it has fewer. Documents
    are linked when their sets' Jaccard similarity is at least ``percent`` / 100, and
    component_id is the smallest doc_id that links lead to. ``kept`` marks the document whose
    id that is.

    Documents without a word have no set and no link: each is its own component. Rows without
    a doc_id are linked with nothing, have no component_id and are kept. Rows that repeat a
    doc_id and its text are one node; a doc_id with several texts is one node with the links
    of all of them. Other columns are not looked at. An empty table gives no rows.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(wanted.mapInArrow(_sketcher(words, k, False), _SKETCHES), "sketches")
    whole = ["n_shingles", "d1", "d2"]
    # Equal digests have equal sketches: any of them will do.
    classes = stored(
        rows.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*whole)
        .agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")),
        "classes",
    )
    lists = stored(inverted_lists(classes, k, percent), "lists")
    sets = stored(
        maybe_in(wanted, F.col("doc_id"), lists, F.col("node")).mapInArrow(
            _sketcher(words, k, True), _SETS
        ),
        "sets",
    ).withColumnRenamed("doc_id", "node")

    members = rows.join(classes.select(*whole, "node"), whole, "left").select(
        "doc_id", "n_shingles", "node"
    )
    # An id with several texts joins their classes.
    ids = (
        members.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    )
    links = members.join(ids, "doc_id").select("a", F.col("node").alias("b")).filter("a < b")
    links = links.unionByName(confirmed(pivot_pairs(by_pivot(lists, None)), sets, k, percent))
    labels = components(links, split_hubs=True)
    entries = stored(by_pivot(lists, labels), "open-lists")
    labels = merged(labels, remaining_links(entries, sets, percent))
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")
    )
    return members.join(labels, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
