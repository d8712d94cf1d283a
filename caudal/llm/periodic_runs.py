"""Periodic runs of words: stretches that repeat a few words at least four times in a row.

Texts become whole numbers, one per different word. Every run with period q that is at least four
periods long covers a point of the grid 0, 3q, 6q, ... together with the word q behind it, so the
grids of all periods (a harmonic sum of points) reach every run. From a point that equals its
partner the run is as long as both can be extended, forwards and, on the reversed words, backwards.

An extension compares words one by one until both places lie in a difference cover, at most
``PERIOD - 1`` words. Few pairs get there. For texts that hold such a pair the suffixes that start
at covered places, and only those, are sorted: first by a block of ``PERIOD`` words, then by
doubling. A sparse table over the common prefixes of neighbours answers the rest of the extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The differences of these six numbers modulo 31 give every number from 0 to 30.
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
# A run repeats its period this often, and has this many words at least.
REPEATS = 4
SHORTEST = 6
# Words that are searched together (a longer text is searched alone), and grid points.
CHUNK = 1 << 18
POINTS = 1 << 21

RUN = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("period", T.LongType()),
])
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _first_shared() -> np.ndarray:
    """[i, d]: the words from a place i (mod PERIOD) and its partner i + d to where both are covered."""
    covered = np.isin(np.arange(PERIOD), COVER)
    steps = np.full((PERIOD, PERIOD), PERIOD, np.int64)
    for step in reversed(range(PERIOD)):
        at = (np.arange(PERIOD) + step) % PERIOD
        both = covered[at][:, None] & covered[(at[:, None] + np.arange(PERIOD)) % PERIOD]
        steps[both] = step
    return steps


STEPS = _first_shared()


def matching(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many words from ``i`` and from ``j`` on are equal, ``limit`` at most."""
    same = np.zeros(len(i), np.int64)
    going = np.flatnonzero(limit > 0)
    while len(going):
        equal = words[i[going] + same[going]] == words[j[going] + same[going]]
        going = going[equal]
        same[going] += 1
        going = going[same[going] < limit[going]]
    return same


class CoveredSuffixes:
    """Common prefixes of any two places whose residues modulo PERIOD are in the cover.

    The length of ``words`` is a multiple of PERIOD, and no two equal stretches reach the end of a
    text: what separates texts is different everywhere.
    """

    def __init__(self, words: np.ndarray) -> None:
        blocks = len(words) // PERIOD
        # The block behind the last one is different from all else, too.
        ends = np.arange(PERIOD, dtype=words.dtype) + words.min(initial=0) - PERIOD - 1
        self.words = np.concatenate([words, ends, ends - PERIOD])
        self.places = (np.arange(blocks)[:, None] * PERIOD + COVER).ravel()
        self.residue = np.full(PERIOD, -1)
        self.residue[COVER] = np.arange(len(COVER))
        rows = np.ascontiguousarray(self.words[self.places[:, None] + np.arange(PERIOD)])
        keys = rows.view(np.dtype((np.void, rows.itemsize * PERIOD))).ravel()
        # names[k]: equal where 2^k blocks from the sample on are equal, in their order.
        self.names = [np.unique(keys, return_inverse=True)[1].astype(np.int64)]
        while self.names[-1].max(initial=-1) < len(self.places) - 1:
            last = self.names[-1]
            ahead = np.minimum(np.arange(len(last)) + (len(COVER) << (len(self.names) - 1)), len(last) - 1)
            pairs = last * len(last) + last[ahead]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        self.rank = self.names[-1]
        order = np.empty(len(self.rank), np.int64)
        order[self.rank] = np.arange(len(order))
        self.table = [self._neighbours(order[:-1], order[1:])]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of samples next to each other in order."""
        a, b, common = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in reversed(range(len(self.names) - 1)):
            equal = self.names[level][a] == self.names[level][b]
            a[equal] += len(COVER) << level
            b[equal] += len(COVER) << level
            common[equal] += PERIOD << level
        return common + matching(self.words, self.places[a], self.places[b], np.full(len(a), PERIOD))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from the covered places ``i`` and ``j`` on, which differ."""
        a, b = (
            self.rank[x // PERIOD * len(COVER) + self.residue[x % PERIOD]] for x in (i, j)
        )
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        found = np.empty(len(i), np.int64)
        for k in np.unique(level):
            of = level == k
            found[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k)])
        return found


class Texts:
    """Some texts' words one behind the other, each from a multiple of PERIOD on.

    At least one separator follows a text; each separator is a number of its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes = sizes
        slots = (sizes // PERIOD + 1) * PERIOD
        self.base = np.concatenate([[0], np.cumsum(slots)])
        within = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        base = np.repeat(self.base[:-1], sizes)
        self.forwards = -1 - np.arange(self.base[-1], dtype=np.int64)
        self.backwards = self.forwards.copy()
        self.forwards[base + within] = words
        self.backwards[base + np.repeat(sizes, sizes) - 1 - within] = words

    def extended(self, words: np.ndarray, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from the places ``i`` and ``j`` of each ``text`` on."""
        a, b = self.base[text] + i, self.base[text] + j
        limit = STEPS[i % PERIOD, (j - i) % PERIOD]
        same = matching(words, a, b, limit)
        more = np.flatnonzero(same == limit)
        if len(more):
            # Only texts that need it are sorted; their places keep their residues.
            needed = np.unique(text[more])
            slots = np.diff(self.base)[needed]
            moved = np.zeros(len(self.sizes), np.int64)
            moved[needed] = self.base[needed] - (np.cumsum(slots) - slots)
            parts = [words[self.base[t]:self.base[t + 1]] for t in needed]
            suffixes = CoveredSuffixes(np.concatenate(parts))
            ahead = limit[more] - moved[text[more]]
            same[more] += suffixes.common(a[more] + ahead, b[more] + ahead)
        return same


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of the grids of all texts and periods, in bounded portions."""
    periods = np.where(sizes >= SHORTEST, sizes // REPEATS, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = np.maximum(SHORTEST, REPEATS * q) - q
    points = (sizes[text] - q - 1) // step + 1
    ends = np.cumsum(points)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - points[first] + POINTS, "right")))
        n = points[first:last]
        of = np.repeat(np.arange(first, last), n)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * step[of]
        yield text[of], place, q[of]
        first = last


def runs_of(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of texts given as numbers one behind
    the other."""
    texts = Texts(sizes, words)
    found = [np.empty((0, 4), np.int64)]
    for text, i, q in _grid(sizes):
        at = texts.base[text] + i
        some = np.flatnonzero(texts.forwards[at] == texts.forwards[at + q])
        text, i, q = text[some], i[some], q[some]
        n = sizes[text]
        ahead = texts.extended(texts.forwards, text, i, i + q)
        # Backwards from the words before i and i + q.
        behind = texts.extended(texts.backwards, text, n - i - q, n - i)
        length = behind + q + ahead
        run = length >= np.maximum(SHORTEST, REPEATS * q)
        found.append(np.stack([text, i - behind, length, q], axis=1)[run])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A stretch found again with a multiple of its smallest period is the same run.
    again = (runs[1:, :3] == runs[:-1, :3]).all(axis=1)
    runs = runs[np.concatenate([[True], ~again])] if len(runs) else runs
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _searched(texts: list[list[bytes]]) -> tuple[list[list[tuple]], list[bytes]]:
    """Each text's runs, and its words without what repeats."""
    numbers = _Numbers()
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    found = runs_of(sizes, words)
    runs: list[list[tuple]] = [[] for _ in texts]
    for text, start, length, period in found.tolist():
        runs[text].append({"start": start, "length": length, "period": period})
    kept = []
    for t, own in zip(texts, runs, strict=True):
        if own:
            # +1 where a run's repeats begin, -1 behind its end: dropped where the sum is not 0.
            edge = np.zeros(len(t) + 1, np.int64)
            np.add.at(edge, [r["start"] + r["period"] for r in own], 1)
            np.add.at(edge, [r["start"] + r["length"] for r in own], -1)
            t = [w for w, inside in zip(t, np.cumsum(edge).tolist(), strict=False) if not inside]
        kept.append(b" ".join(t))
    return runs, kept


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = _searched(texts)
        columns = [rows.column(0), pa.array(runs, _ARROW_RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["_key", "runs", "collapsed"])

    for batch in batches:
        texts, held, first = [], 0, 0
        for row, text in enumerate(batch.column(1)):
            # Bytes split at the six ASCII white spaces, and at nothing else.
            words = (text.as_py() or b"").split()
            texts.append(words)
            held += len(words)
            if held >= CHUNK or row == batch.num_rows - 1:
                yield made(batch.slice(first, len(texts)), texts)
                texts, held, first = [], 0, row + 1


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period), collapsed: one row per row of ``docs``.

    Words are what lies between ASCII white space, numbered from 0. A run has a smallest period
    q, at least max(6, 4q) words, and cannot be extended; runs are ordered by start, then period,
    and may overlap. ``collapsed`` joins by one space the words that no run holds behind its first
    q words. A NULL or empty text has no runs and an empty ``collapsed``; ids may be NULL or
    repeat, each row is answered; other columns are not looked at; an empty table gives no rows.

    Rows are independent, so there is no shuffle. Memory is bounded by ``CHUNK`` words or the
    longest text; a text of n words has about n ln(n) / 3 grid points, taken in portions.
    """
    keyed = docs.select(F.col(id_col).alias("_key"), F.col(text_col).cast("binary").alias("_text"))
    kind = docs.schema[id_col].dataType
    made = T.StructType([
        T.StructField("_key", kind), T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ])
    return keyed.mapInArrow(_search, made).withColumnRenamed("_key", "doc_id")


def repeating_tail(doc_id: Column, text: Column) -> Column:
    """The text in which, for every tenth document by checksum, the words from one place on
    repeat the first of them; the others unchanged."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # One expression over an array of a single struct, so that words are split once.
    def joined(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        repeated = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(x["w"], F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
        )
        return F.when(n > 0, F.array_join(repeated, " ")).otherwise(text)

    changed = F.transform(F.array(F.struct(words.alias("w"))), joined)[0]
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)
