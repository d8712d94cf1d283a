"""Near-equal lines by a segment-partition edit join.

How many edits k two lines may be apart follows from the shorter one's length (``Limit``). Lengths are
dealt into classes; all lines of a class are cut into k + 1 segments of one size, the first half
placed from the line's begin, the second from its end. k edits leave one of them untouched, so the
other line has it as a substring, near the same place. Segments are indexed under (class, number,
text); a line probes the index with its own substrings at just the places where the segment could
lie if the edits before it and behind it are to stay within the limit. A line that is within k of
the class below is in that class, too.

A segment that many lines hold is split: what is left of each of these lines without it is within k
edits, too, and is cut and probed in the same way. Candidates whose lengths or letter counts differ
too much are left out where they are joined, the others are verified there, once a pair, by a banded
bit-parallel edit distance. Only Spark's own operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caudal.llm.common import maybe_in, stored
from caudal.llm.graph import components

# Edits allowed from a length on; shorter lines only equal themselves.
STEPS = ((10, 1), (24, 2), (80, 3))
# Lengths of a class for each edit of the limit.
WIDTH = 3
# A segment of more lines than this is split by the segments of what is left.
HELD = 64
# Characters that are counted to compare lines.
COUNTED = " etaoinsrhldcumgp"
# Cut off both ends of a line.
WHITE = " \t\x0b\x0c\r"


@dataclass(frozen=True)
class Limit:
    """Edits between two lines by the shorter one's length: (from that many characters on, edits)."""

    steps: tuple[tuple[int, int], ...] = STEPS

    @property
    def values(self) -> list[int]:
        return sorted({k for _, k in self.steps})

    def column(self, n: Column) -> Column:
        return self._step(n, lambda at, k: k)

    def lowest(self, n: Column) -> Column:
        """The first length of the class of ``n``; no class has two limits.

        A class is ``WIDTH`` times as many lengths as the limit has edits: one in ``WIDTH`` lines is
        in two classes.
        """
        most = F.greatest(self.column(n), F.lit(1))
        return n - (n - self._step(n, lambda at, k: at)) % (WIDTH * most)

    def _step(self, n: Column, value) -> Column:
        found = F.lit(-1)
        for at, k in self.steps:
            found = F.when(n >= at, value(at, k)).otherwise(found)
        return found


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line), a row per line that is not blank."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "raw"),
    )
    return rows.select("doc_id", "line_no", F.btrim("raw", F.lit(WHITE)).alias("line")).filter("line <> ''")


def _specs(edits: int) -> Column:
    """What a line is cut and probed by: a constant array, to be exploded.

    Some segment is untouched with at most as many edits before it as segments, and at most as many
    behind it, so it is moved by ``reach`` at most, seen from the end of the line that is nearer.
    ``reach`` characters behind each segment are left out of the text and may not be touched, either:
    then the line that has them nearer to that end has a segment of its own in them, which the other
    has 0 to ``reach`` characters further away. So probes go one way only. ``ahead`` segments and
    ``left`` characters lie between a segment and its end.
    """
    reach = [min(number, edits - number) for number in range(edits + 1)]
    made = []
    for number in range(edits + 1):
        from_end = number > edits - number
        ahead = edits - number if from_end else number
        left = sum(reach[number + 1:] if from_end else reach[:number])
        made += [
            f"named_struct('number', {number}, 'from_end', {str(from_end).lower()}, 'ahead', {ahead}, "
            f"'left', {left}, 'off', {off}, 'spare', {sum(reach)})"
            for off in range(reach[number] + 1)
        ]
    return F.expr(f"array({', '.join(made)})")


def _cut(lines: DataFrame, limit: Limit) -> DataFrame:
    """``lines`` (line, n_chars, ...) by the substrings that are their own segments or that probe
    for those of other lines: own, key, and start (from 1), size, edits, low of the text.

    ``low`` is the first length of the class. A row per substring, so that the hash of one is all
    there is to an expression.
    """
    # The classes of the lines that may be the shorter one of a pair.
    shorter = [(F.col("n_chars") - shift, shift) for shift in range(max(limit.values) + 1)]
    classes = F.array_distinct(F.array_compact(F.array(*[
        F.when(limit.column(n) >= shift, limit.lowest(n)) for n, shift in shorter
    ])))
    rows = lines.withColumn("low", F.explode(classes)).withColumn("edits", limit.column(F.col("low")))
    return _segments(rows, limit).select(
        *lines.columns, "start", "size", "edits", "low", (F.col("off") == 0).alias("own"),
        F.xxhash64("low", "number", F.expr("substring(line, start, size)")).alias("key"),
    )


def _segments(rows: DataFrame, limit: Limit) -> DataFrame:
    """A row of ``rows`` (line, n_chars, low, edits, ...) for each segment and probe of a line whose
    class begins at ``low``: adds number, off, start and size."""
    specs = F.lit(None)
    for edits in limit.values:
        specs = F.when(F.col("edits") == edits, _specs(edits)).otherwise(specs)
    rows = rows.withColumn("spec", F.explode(specs)).select(*rows.columns, "spec.*")
    rows = rows.withColumn("size", F.expr("int(greatest(0, low - spare) div (edits + 1))"))
    begin = F.expr("ahead * size + left + off")
    start = F.when(F.col("from_end"), F.col("n_chars") - begin - F.col("size")).otherwise(begin) + 1
    return rows.withColumn("start", start.cast("int")).drop("from_end", "ahead", "left", "spare")


def distinct_lines(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """One stored row per different line: where it is first, how often, and its length.

    Lines are told apart by a 128-bit digest; their text does not travel. Counts are combined
    before the shuffle, so a line that very many documents have is no large group.
    """
    keyed = lines_of(docs, id_col, text_col).select(
        F.unhex(F.md5("line")).alias("digest"), F.char_length("line").alias("n_chars"),
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no").alias("place"),
    )
    found = keyed.groupBy("digest", "n_chars").agg(F.min("place").alias("place"), F.count("*").alias("n_rows"))
    return stored(found.withColumn("line_id", F.monotonically_increasing_id()), "lines")


def shared_keys(docs: DataFrame, limit: Limit, *, id_col: str, text_col: str) -> DataFrame:
    """(key, own, mark, held), stored: the keys that several lines have, one of them as a segment.

    ``mark`` is a hash of the line. ``held`` is whether more than ``HELD`` entries have the key.
    """
    lines = lines_of(docs, id_col, text_col).select(
        "line", F.char_length("line").alias("n_chars"), F.xxhash64("line").alias("mark")
    )
    lines = lines.filter(F.col("n_chars") >= limit.steps[0][0])
    entries = _cut(lines, limit).select("key", "own", "mark")
    # One shuffle serves the counts and the rows they are joined to.
    entries = entries.repartition("key")
    shared = entries.groupBy("key").agg(
        F.min("mark").alias("low"), F.max("mark").alias("high"), F.max("own").alias("indexed"),
        (F.count("*") > HELD).alias("held"),
    ).filter("low < high AND indexed").select("key", "held")
    return stored(entries.join(shared, "key").distinct(), "line-lists")


def counts_of(line: Column) -> Column:
    """How often a line has each of ``COUNTED``, up to what a short number holds.

    An edit changes two of the numbers at most, by one each.
    """
    return F.array(*[
        F.least(F.char_length(line) - F.char_length(F.replace(line, F.lit(c))), F.lit(32_767)).cast("short")
        for c in COUNTED
    ])


def texts_of(docs: DataFrame, lines: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(line_id, mark, n_chars, line, counts) of lines with the given marks, read again."""
    read = lines_of(docs, id_col, text_col).withColumn("mark", F.xxhash64("line"))
    wanted = marks.select(F.col("mark").alias("_mark")).distinct()
    near = maybe_in(read, F.col("mark"), wanted, F.col("_mark"))
    near = near.join(wanted, F.col("mark") == F.col("_mark"), "left_semi")
    one = near.withColumn("digest", F.unhex(F.md5("line"))).groupBy("digest", "mark").agg(
        # The same for all rows of a digest.
        F.first("line").alias("line")
    )
    found = one.join(lines.select("line_id", "digest", "n_chars"), "digest")
    return stored(
        found.select("line_id", "mark", "n_chars", "line", counts_of(F.col("line")).alias("counts")), "line-texts"
    )


def split_keys(lists: DataFrame, texts: DataFrame, limit: Limit) -> DataFrame:
    """(key, own, mark): entries of the keys that many lines hold, under keys that add a segment
    of what is left of the line."""
    held = lists.filter("held")
    few = texts.join(held.select("mark").distinct(), "mark", "left_semi")
    placed = _cut(few.select("mark", "line", "n_chars"), limit)
    placed = placed.join(held.select("key").distinct(), "key", "left_semi")
    # The same is taken from all lines of a key, so what is left is of one class, too.
    rest = placed.select(
        "key", "mark", "edits", (F.col("low") - F.col("size")).alias("low"),
        (F.col("n_chars") - F.col("size")).alias("n_chars"),
        F.expr("concat(substring(line, 1, start - 1), substring(line, start + size))").alias("line"),
    )
    return stored(_segments(rest, limit).select(
        F.xxhash64("key", "number", F.expr("substring(line, start, size)")).alias("key"),
        (F.col("off") == 0).alias("own"), "mark",
    ).distinct(), "line-split-lists")


def met_keys(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, mark, own, rows, columns) of the keys by which lines can meet, each line once a key, and
    (mark, keys, owned): the keys of each line and those that are its own segments'.

    ``rows`` and ``columns`` are the slices of about ``HELD`` that the key's segments and all its
    lines make. A line has as many keys as its limit has places, whatever the input.
    """
    once = lists.groupBy("key", "mark").agg(F.max("own").alias("own"))
    of_key = once.groupBy("key").agg(
        F.min("mark").alias("low"), F.max("mark").alias("high"),
        F.ceil(F.count_if("own") / HELD).cast("int").alias("rows"),
        F.ceil(F.count("*") / HELD).cast("int").alias("columns"),
    )
    met = of_key.filter("low < high AND rows > 0").select("key", "rows", "columns")
    entries = stored(once.join(met, "key"), "line-met-keys")
    return entries, entries.groupBy("mark").agg(
        F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("own"), F.col("key"))).alias("owned")
    )


def linked_pairs(lists: DataFrame, texts: DataFrame, limit: Limit) -> DataFrame:
    """Links (a, b), each once: lines that share a key and are within the limit.

    The join itself leaves out what lengths and counts do not allow, takes a pair under the
    smallest key that brings it together and there compares the lines, so that it gives nothing but
    links. The segments of a key and its lines are dealt over slices of about ``HELD``, and each
    two slices meet in a cell of their own: a key that very many lines hold is as many tasks as it
    has cells, and no pair of it is left out.
    """
    entries, of_line = met_keys(lists)
    lines = texts.join(of_line, "mark").select("mark", "line_id", "n_chars", "counts", "line", "keys", "owned")
    full = entries.join(lines, "mark")
    place = F.xxhash64("line_id")
    first, last = F.lit(0), lambda n: F.col(n) - 1
    index = full.filter("own").select(
        F.col("key").alias("key_i"), F.pmod(place, F.col("rows")).cast("int").alias("row_i"),
        F.explode(F.sequence(first, last("columns"))).alias("column_i"),
        *[F.col(c).alias(f"{c}_i") for c in ("line_id", "n_chars", "counts", "line", "keys", "owned")],
    )
    probes = full.select(
        F.col("key").alias("key_p"), F.pmod(place, F.col("columns")).cast("int").alias("column_p"),
        F.explode(F.sequence(first, last("rows"))).alias("row_p"), "own",
        *[F.col(c).alias(f"{c}_p") for c in ("line_id", "n_chars", "counts", "line", "keys", "owned")],
    )
    most = limit.column(F.least("n_chars_i", "n_chars_p"))
    gap = F.lit(0)
    for at in range(len(COUNTED)):
        gap = gap + F.abs(F.get("counts_i", F.lit(at)).cast("int") - F.get("counts_p", F.lit(at)).cast("int"))
    smallest = F.least(
        F.array_min(F.array_intersect("owned_i", "keys_p")), F.array_min(F.array_intersect("keys_i", "owned_p"))
    )
    links = index.join(
        probes,
        (F.col("key_i") == F.col("key_p")) & (F.col("row_i") == F.col("row_p"))
        & (F.col("column_i") == F.col("column_p")) & (F.col("line_id_i") != F.col("line_id_p"))
        & (~F.col("own") | (F.col("line_id_i") < F.col("line_id_p")))
        & (F.abs(F.col("n_chars_i") - F.col("n_chars_p")) <= most) & (gap <= 2 * most)
        & (F.col("key_i") == smallest) & within_limit(F.col("line_i"), F.col("line_p"), limit),
    )
    return links.select(
        F.least("line_id_i", "line_id_p").alias("a"), F.greatest("line_id_i", "line_id_p").alias("b")
    )


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the expression names it."""
    return F.transform(F.array(value), use)[0]


def within_edits(left: Column, right: Column, edits: int) -> Column:
    """Whether two texts are at most ``edits`` insertions, deletions or substitutions apart.

    A band of 2 ``edits`` + 1 cells of the distance table is kept as bits of one number and
    updated for a whole column at once. Common beginnings and ends are cut off first. A pair that is
    surely too far apart is not followed further.
    """
    swap = F.char_length(left) > F.char_length(right)
    pair = F.struct(
        F.split(F.when(swap, right).otherwise(left), "").alias("a"),
        F.split(F.when(swap, left).otherwise(right), "").alias("b"),
    )

    def with_head(p: Column) -> Column:
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), _common(p["a"], p["b"]).alias("head"))

    def with_tail(p: Column) -> Column:
        behind = _common(F.reverse(p["a"]), F.reverse(p["b"]))
        tail = F.least(behind, F.least(F.size(p["a"]), F.size(p["b"])) - p["head"])
        return F.struct(p["a"].alias("a"), p["b"].alias("b"), p["head"].alias("head"), tail.alias("tail"))

    def trimmed(p: Column) -> Column:
        # The same few marks behind each leave room for the band and change no distance.
        cut = lambda x: F.concat(
            F.slice(x, p["head"] + 1, F.greatest(F.size(x) - p["head"] - p["tail"], F.lit(0))),
            F.array_repeat(F.lit(""), edits),
        )
        return F.struct(cut(p["a"]).alias("a"), cut(p["b"]).alias("b"))

    def distance(p: Column) -> Column:
        return _let(trimmed(p), lambda q: _banded(q["a"], q["b"], edits))

    return _let(pair, lambda p: _let(with_head(p), lambda h: _let(with_tail(h), distance)))


def _common(x: Column, y: Column) -> Column:
    """How many characters both begin with."""
    differ = F.array_position(F.zip_with(x, y, lambda s, t: ~s.eqNullSafe(t)), True)
    return F.when(differ > 0, differ - 1).otherwise(F.size(x)).cast("int")


def _banded(a: Column, b: Column, edits: int) -> Column:
    """Bit t of a column's words is the cell ``edits`` - t rows above the diagonal.

    ``vp`` and ``vn``: where the table rises or falls from one row to the next. The distance
    runs down the band's last diagonal to the last row and then along it.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    rows, columns = F.size(a), F.size(b)
    zero = F.lit(0).cast("long")
    begin = F.struct(
        F.lit(full ^ ((1 << edits) - 1)).cast("long").alias("vp"), zero.alias("vn"),
        F.lit(edits).cast("long").alias("distance"),
    )
    invert = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(full).cast("long"))

    def column(state: Column, j: Column) -> Column:
        char = F.get(b, j - 1)
        same = zero
        for t in range(width):
            here = F.get(a, j - edits + t - 1).eqNullSafe(char)
            same = same + F.when(here, F.lit(1 << t).cast("long")).otherwise(zero)
        return _let(same, lambda eq: deltas(state, eq, j))

    def deltas(state: Column, same: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        d0 = (
            (same.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(same).bitwiseOR(vn)
            .bitwiseAND(F.lit(full).cast("long"))
        )
        return _let(d0, lambda d: after(state, d, j))

    def after(state: Column, d0: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        step = F.struct(vn.bitwiseOR(invert(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"))
        return _let(step, lambda h: moved(state, d0, h["hp"], h["hn"], j))

    def moved(state: Column, d0: Column, hp: Column, hn: Column, j: Column) -> Column:
        down = F.shiftright(d0, 1)
        # The cell of the last row in this column, once the band reaches below it.
        bit = lambda word, t: word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), t)) != 0
        place = (rows - j + edits).cast("int")
        diagonal = F.when(bit(d0, F.lit(2 * edits)), 0).otherwise(1)
        along = F.when(bit(hp, place), 1).when(bit(hn, place), -1).otherwise(0)
        change = F.when(j + edits <= rows, diagonal).otherwise(along)
        return F.struct(
            hn.bitwiseOR(invert(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
            (state["distance"] + change).cast("long").alias("distance"),
        )

    def followed(state: Column, j: Column) -> Column:
        # Cells of a column differ by 2 ``edits`` at most, so none of them is within ``edits`` then.
        return F.when(state["distance"] > 3 * edits, state).otherwise(column(state, j))

    done = F.aggregate(F.sequence(F.lit(1), columns), begin, followed)
    return (columns - rows <= edits) & (done["distance"] <= edits)


def within_limit(left: Column, right: Column, limit: Limit) -> Column:
    """Whether two texts are within the edits that the shorter one allows."""
    most = limit.column(F.least(F.char_length(left), F.char_length(right)))
    near = F.lit(False)
    for edits in limit.values:
        near = F.when(most == edits, within_edits(left, right, edits)).otherwise(near)
    return near


def near_equal_lines(
    docs: DataFrame, *, steps: tuple[tuple[int, int], ...] = STEPS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per different line: doc_id and line_no (from 0) where it is first, n_chars, n_rows,
    n_links, class_doc_id and class_line_no of the first line of its class, kept.

    White space around lines does not count; blank lines are no lines. Two lines are linked
    when they are within the edits that ``steps`` allows the shorter one. n_links is the number of
    other lines a line is linked with, and a class is what links connect. Each more edit costs a
    line about k ** 2 more keys. Lines of documents without an id come behind all others. A NULL
    text has no lines; rows repeated add to n_rows; other columns are not looked at; an empty
    table gives no rows.
    """
    limit = Limit(steps)
    columns = {"id_col": id_col, "text_col": text_col}
    lines = distinct_lines(docs, **columns)
    lists = shared_keys(docs, limit, **columns)
    texts = texts_of(docs, lines, lists.select("mark"), id_col, text_col)
    lists = lists.filter("NOT held").select("key", "own", "mark").unionByName(split_keys(lists, texts, limit))
    links = stored(linked_pairs(lists, texts, limit), "line-links")
    degree = links.select(F.explode(F.array("a", "b")).alias("line_id")).groupBy("line_id").agg(F.count("*").alias("n_links"))
    labels = components(links).withColumnRenamed("node", "line_id")
    linked = lines.select("line_id", "place").join(labels, "line_id")
    heads = linked.groupBy("component").agg(F.min("place").alias("head"))
    classes = stored(
        labels.join(heads, "component").join(degree, "line_id").select("line_id", "head", "n_links"), "line-classes"
    )
    all_lines = lines.select("line_id", "place", "n_chars", "n_rows").join(classes, "line_id", "left")
    head = F.coalesce("head", "place")
    return all_lines.select(
        F.col("place.doc_id").alias("doc_id"), F.col("place.line_no").alias("line_no"), "n_chars", "n_rows",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        head["doc_id"].alias("class_doc_id"), head["line_no"].alias("class_line_no"),
        (F.col("head").isNull() | (F.col("head") == F.col("place"))).alias("kept"),
    )
