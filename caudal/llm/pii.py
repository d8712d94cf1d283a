"""Personal data by bootstrapped contextual extraction.

Fixed patterns find seed entities of four kinds. The words around a seed are lexical patterns.
Everything else that looks like an identifier is a candidate, with patterns of its own. Spark
scores the graph of patterns and instances in a few rounds: a pattern is as good as the
instances it surrounds, an instance as good as the patterns around it. Candidates that
patterns of high confidence surround become identifiers of the pattern's kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from caudal.llm.common import stored

# Fixed values of the task: kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What looks like an identifier: groups of digits joined by spaces, dots, dashes, slashes or
# parentheses, or a run of word characters and the marks that join them. Either needs so many
# digits in all, unless the run has an @ or two colons inside.
_CANDIDATE = re.compile(
    r"(?P<groups>(?<![\w@])[+(]{0,2}\d+(?:[ \xa0.()/-]{1,3}\d+)*(?![./-]*[\w@:]))"
    r"|(?:[\w@+]|:(?=:))(?:[\w@+./%-]|:(?=[\w:]))*"
)
_JOINTS = " \xa0./-"
CANDIDATE_DIGITS = 6
_WORD = re.compile(r"[^\W\d_]+")
CONTEXT = 80

# A pattern counts from this many different seeds on, and both scores must reach CONFIDENT.
MIN_SEEDS = 5
CONFIDENT = 0.9
ROUNDS = 3

_SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
])
_MENTION = T.StructType([
    *_SPAN.fields, T.StructField("instance", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
])
_FOUND = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()),
    *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("base", T.ArrayType(_SPAN)),
    T.StructField("mentions", T.ArrayType(_MENTION)),
])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: no other character can be that @."""
    last = 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > last and (text[low - 1] in "._%+-" or (text[low - 1].isascii() and text[low - 1].isalnum())):
            low -= 1
        domain = _DOMAIN.match(text, at + 1) if low < at else None
        if domain:
            last = domain.end()
            yield low, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def context_patterns(text: str, start: int, end: int) -> list[str]:
    """Two words before, one before and one after, two after, as far as they are there."""
    left = _WORD.findall(text[max(0, start - CONTEXT):start].lower())[-2:]
    right = _WORD.findall(text[end:end + CONTEXT].lower())[:2]
    made = []
    if len(left) == 2:
        made.append(f"{left[0]} {left[1]} *")
    if left and right:
        made.append(f"{left[-1]} * {right[0]}")
    if len(right) == 2:
        made.append(f"* {right[0]} {right[1]}")
    return made


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What looks like an identifier and overlaps none of ``taken``, in order."""
    at = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if m["groups"] is None:
            # A single colon ends a label.
            parts = [(a, b)]
            if text.count(":", a, b) == 1:
                colon = text.index(":", a)
                parts = [(a, colon), (colon + 1, b)]
            if at < len(taken) and taken[at][0] < b:
                continue
        else:
            # Groups beside a fixed match are a sequence of their own.
            parts, k = [], at
            while k < len(taken) and taken[k][0] < b:
                parts.append((a, taken[k][0]))
                a = max(a, taken[k][1])
                k += 1
            parts.append((a, b))
        for low, high in parts:
            while low < high and text[high - 1] in _JOINTS + "(:":
                high -= 1
            while low < high and text[low] in _JOINTS + ")":
                low += 1
            inner = text[low + 1:high - 1]
            if "@" in inner or inner.count(":") > 1 or (
                text.count(":", low, high) > 1 and high - low > 2
            ) or sum(map(str.isdigit, text[low:high])) >= CANDIDATE_DIGITS:
                yield low, high


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple]:
    """Seeds with their kind, and candidates without one, with their context patterns."""
    found = [(k, a, b, text[a:b].lower(), context_patterns(text, a, b)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    found += [
        (None, a, b, text[a:b].lower(), context_patterns(text, a, b)) for a, b in _candidates(text, taken)
    ]
    return found


def _scan(place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for text in batch.column(place).to_pylist():
                    spans = base_spans(text or "")
                    counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                    key = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                    rows.append((
                        part, row, *counts, hashlib.sha256(key.encode()).hexdigest(),
                        spans, mentions(text or "", spans),
                    ))
                    row += 1
                made = _arrow_rows(rows)
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return run


_SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION_ARROW = pa.struct([*_SPAN_ARROW, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _arrow_rows(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int64(), *[pa.int64()] * len(KINDS), pa.string()]
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
    spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in columns[-2]]
    keys = ("kind", "start", "end", "instance", "patterns")
    found = [[dict(zip(keys, s, strict=True)) for s in x] for x in columns[-1]]
    return [*made, pa.array(spans, pa.list_(_SPAN_ARROW)), pa.array(found, pa.list_(_MENTION_ARROW))]


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the columns of ``_FOUND``, stored; columns of those names are replaced."""
    kept = [c for c in docs.columns if c not in _FOUND.names]
    schema = T.StructType([docs.schema[c] for c in kept] + _FOUND.fields)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    return stored(rows.mapInArrow(_scan(kept.index(text_col), schema.names), schema), "pii-scan")


def pattern_graph(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind, n): how often a pattern surrounds an instance; kind is NULL
    for candidates."""
    one = found.select(F.explode("mentions").alias("m"))
    edges = one.select(
        F.explode("m.patterns").alias("pattern"), F.xxhash64("m.instance").alias("instance"),
        F.col("m.kind").alias("kind"),
    )
    return edges.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"))


def scored_candidates(
    found: DataFrame, *, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS
) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and of candidate instances, each by kind.

    Seeds score 1 for their kind. A pattern's score for a kind is the mean of its instances'
    scores; it needs ``min_seeds`` different seeds. A candidate's score is one minus the
    product of its patterns' doubts. Every step adds up per key before the shuffle, so a
    pattern or instance that is very frequent is no large group.
    """
    graph = pattern_graph(found)
    support = graph.groupBy("pattern").agg(
        F.count("*").alias("instances"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS],
    )
    # Only patterns with enough seeds of one kind can ever score; this keeps the graph small.
    usable = support.select(
        "pattern", "instances",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds")) for k in KINDS])).alias("s"),
    ).select("pattern", "instances", "s.kind", "s.seeds").filter(F.col("seeds") >= min_seeds)
    patterns = stored(usable.withColumn("score", F.col("seeds") / F.col("instances")), "pii-patterns")
    open_ends = stored(
        graph.filter("kind IS NULL").select("pattern", "instance")
        .join(patterns.select("pattern").distinct(), "pattern", "left_semi"),
        "pii-candidates",
    )
    for _ in range(rounds):
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        instances = (
            open_ends.join(patterns.select("pattern", "kind", "score"), "pattern")
            .groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("instance_score"))
        )
        gained = open_ends.join(instances, "instance").groupBy("pattern", "kind").agg(
            F.sum("instance_score").alias("gained")
        )
        patterns = stored(
            patterns.join(gained, ["pattern", "kind"], "left").select(
                "pattern", "instances", "kind", "seeds",
                F.least(
                    (F.col("seeds") + F.coalesce("gained", F.lit(0.0)) * F.col("seeds") / F.col("instances"))
                    / F.col("instances"),
                    F.lit(1.0),
                ).alias("score"),
            ),
            "pii-patterns",
        )
    return patterns, instances


def discovered(found: DataFrame, *, confident: float = CONFIDENT, **params) -> DataFrame:
    """(part, row, added): the spans of candidates that high-confidence patterns surround."""
    patterns, instances = scored_candidates(found, **params)
    good_patterns = patterns.filter(F.col("score") >= confident).select("pattern", "kind")
    good = instances.filter(F.col("instance_score") >= confident)
    candidates = (
        found.select("part", "row", F.explode("mentions").alias("m")).filter("m.kind IS NULL")
        .select(
            "part", "row", F.col("m.start").alias("start"), F.col("m.end").alias("end"),
            F.xxhash64("m.instance").alias("instance"), F.explode("m.patterns").alias("pattern"),
        )
    )
    # One kind a span: the one whose score is highest, the first of equals.
    kinds = F.array(*[F.lit(k) for k in KINDS])
    rank = F.struct(-F.col("instance_score"), F.array_position(kinds, F.col("kind")), "kind")
    spans = (
        candidates.join(good_patterns, "pattern").join(good, ["instance", "kind"])
        .groupBy("part", "row", "start", "end").agg(F.min(rank).alias("best"))
    )
    # A document's own spans: as many as it has candidates.
    return spans.groupBy("part", "row").agg(
        F.collect_list(F.struct(F.col("best.kind").alias("kind"), "start", "end")).alias("added")
    )


def find_personal_data(docs: DataFrame, *, text_col: str = "text", **params) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256 and all_spans.

    Whole texts are read; NULL counts as empty and has no spans. The counts and base_sha256 are
    of the fixed patterns; all_spans, an array of (kind, start, end) in code points ordered by
    kind and start, has the discovered identifiers as well, which never overlap a fixed match.
    Rows are told apart by their place, so repeated rows and rows without an id are all
    returned. Input columns with the names of result columns are replaced; an empty table
    gives no rows.
    """
    kept = [c for c in docs.columns if c not in (*_FOUND.names, "added", "all_spans")]
    found = scanned(docs.select(*[F.col(f"`{c}`") for c in kept]), text_col)
    added = discovered(found, **params)
    # Most documents have no candidate and need not travel to meet what was found.
    maybe = F.exists("mentions", lambda m: m["kind"].isNull())
    none = F.lit(None).cast(T.ArrayType(_SPAN))
    rows = found.filter(~maybe).withColumn("added", none).unionByName(
        found.filter(maybe).join(added, ["part", "row"], "left")
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.transform(
        F.concat("base", F.coalesce("added", F.array().cast(T.ArrayType(_SPAN)))),
        lambda s: F.struct(
            F.array_position(kinds, s["kind"]).alias("place"), s["start"].alias("start"),
            s["end"].alias("end"), s["kind"].alias("kind"),
        ),
    ))
    spans = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], *[f"n_{k}" for k in KINDS], "base_sha256",
        spans.alias("all_spans"),
    )


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping ones become one."""
    by_start = F.array_sort(F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    ))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= done["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], gap, mark).alias("out"))

    done = F.aggregate(by_start, begin, step)
    rest = lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(rest(done))
