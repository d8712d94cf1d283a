"""Language identification with a string kernel.

The kernel of two texts compares which character n-grams of several lengths (a blended
spectrum) they contain: common n-grams over the geometric mean of both numbers. A few labelled
texts serve as Nystrom landmarks, one-versus-rest kernel ridge regression is fitted on their
feature space, and texts are scored in batches by two matrix products.

A text is scored in blocks of ``BLOCK`` code points, each of which has far fewer n-grams than there
are buckets, and its scores are the blocks' mean, weighted by their lengths. A text of any length
is judged by all of itself, and one that fits a block by one kernel value a landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

UNDETERMINED = "und"
# n-gram lengths, and the buckets they are hashed to. One bucket more or less changes a kernel
# value by one n-gram; texts are compared by thousands.
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
# Bounds of what the driver gathers to fit the model: texts per language, each one block of its
# text, and languages, those with the most labelled texts. The model that is broadcast has a
# column of at most BUCKETS floats for each landmark, 4 MB a language.
SAMPLE_PER_LANGUAGE = 300
LANGUAGES = 128
LANDMARKS_PER_LANGUAGE = 16
RIDGE = 1e-2
# Blocks of one matrix product, and code points of a block.
ROWS = 64
BLOCK = 8192

_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**31, (len(ORDERS), max(ORDERS)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_LETTER = re.compile(r"[^\W\d_]")
_RESULT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
])


def presence(block: str) -> np.ndarray:
    """Which buckets the n-grams of a block of text fall into, as 0 and 1 bytes.

    Lower-cased; a run of ASCII characters that are no letters counts as one space, so that
    neither numbers nor punctuation tell languages apart.
    """
    seen = np.zeros(BUCKETS, np.uint8)
    codes = np.frombuffer(block.lower().encode("utf-32-le"), np.uint32)
    codes = np.where((codes < 97) | ((codes > 122) & (codes < 128)), 32, codes)
    if len(codes) > 1:
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    for order, factors in zip(ORDERS, _MULTIPLIERS, strict=True):
        n = len(codes) - order + 1
        if n < 1:
            continue
        total = np.full(n, order, np.uint32)
        for i in range(order):
            total += codes[i:n + i] * factors[i]
        total *= np.uint32(0x9E3779B1)
        seen[total >> np.uint32(16)] = 1
    return seen


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # buckets x landmarks, scaled by each landmark's norm
    columns: np.ndarray    # the buckets that any landmark has
    weights: np.ndarray    # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        """Texts x languages, -1 to 1 roughly: how much each language's regression agrees."""
        total = np.zeros((len(texts), len(self.languages)))
        places = [(i, at) for i, text in enumerate(texts) for at in range(0, len(text), BLOCK)]
        for first in range(0, len(places), ROWS):
            batch = places[first:first + ROWS]
            rows = np.empty((len(batch), len(self.columns)), np.float32)
            norms = np.empty((len(batch), 1), np.float32)
            for j, (i, at) in enumerate(batch):
                seen = presence(texts[i][at:at + BLOCK])
                rows[j] = seen[self.columns]
                norms[j] = max(1.0, np.count_nonzero(seen)) ** 0.5
            found = ((rows @ self.landmarks) / norms) @ self.weights
            for (i, at), score in zip(batch, found, strict=True):
                total[i] += score * (min(BLOCK, len(texts[i]) - at) / len(texts[i]))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, sure = [], []
        for at in range(0, len(texts), ROWS):
            part = texts[at:at + ROWS]
            known = [bool(t and _LETTER.search(t)) for t in part]
            found = iter(self.scores([t for t, k in zip(part, known, strict=True) if k]))
            for k in known:
                if not k or not self.languages:
                    names.append(UNDETERMINED)
                    sure.append(0.0)
                    continue
                row = next(found)
                best = int(np.argmax(row))
                names.append(self.languages[best])
                sure.append(float(np.clip((row[best] + 1) / 2, 0, 1)))
        return names, sure


def fit(texts: list[str], labels: list[str], *, ridge: float = RIDGE) -> Model:
    """Nystrom features from evenly chosen landmarks, then ridge regression per language."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0, int), np.zeros((0, 0), np.float32))
    chosen = [
        i for name in languages
        for i in [j for j, x in enumerate(labels) if x == name][:LANDMARKS_PER_LANGUAGE]
    ]
    seen = np.stack([presence(t) for t in texts])
    norms = np.maximum(1, seen.sum(1, dtype=np.float64)) ** 0.5
    columns = np.flatnonzero(seen[chosen].any(0))
    scaled = seen[chosen][:, columns].astype(np.float32) / norms[chosen, None].astype(np.float32)
    kernel = np.vstack([
        seen[at:at + ROWS, columns].astype(np.float32) @ scaled.T
        for at in range(0, len(seen), ROWS)
    ]).astype(np.float64) / norms[:, None]
    # K_mm^(-1/2) from the landmarks' own kernel; tiny eigenvalues are left out.
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Languages with few texts weigh as much as others.
    weight = np.array([1 / labels.count(x) for x in labels])[:, None]
    weight *= len(labels) / len(languages)
    gram = features.T @ (features * weight) + ridge * len(labels) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (target * weight))
    return Model(languages, scaled.T.copy(), columns, (root @ solved).astype(np.float32))


def training_sample(
    docs: DataFrame, held_out: Column, *, id_col: str, text_col: str, lang_col: str,
    per_language: int, languages: int = LANGUAGES,
) -> list[tuple[str, str]]:
    """(language, block of a text) to learn from, a bounded number of bounded texts.

    Of each of the ``languages`` values with the most texts (ties: the smaller value) at most
    ``per_language`` texts are taken by a hash of the id, and of each the block that another hash
    names. Of rows that repeat an id and a language the smallest block is taken.
    """
    usable = docs.filter(
        F.col(lang_col).isNotNull() & ~held_out & F.col(text_col).rlike(r"\p{L}")
    )
    ids = usable.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"))
    known = [
        r["lang"]
        for r in ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
        .limit(languages).collect()
    ]
    # Spark keeps each language's first rows before anything is moved, and no text is sorted.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        ids.filter(F.col("lang").isin(known)).withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_language).collect()
    )
    place = {(r["lang"], r["doc_id"]): r["place"] for r in chosen}
    text = F.col(text_col)
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.ceil(F.char_length(text) / BLOCK))
    blocks = usable.filter(F.col(id_col).isin([doc_id for _, doc_id in place])).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
        F.substring(text, (block * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("text"),
    )
    one = blocks.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    kept = [(r["lang"], place[r["lang"], r["doc_id"]], r["text"]) for r in one if (r["lang"], r["doc_id"]) in place]
    return [(lang, text) for lang, _, text in sorted(kept)]


def held_out_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a row without an id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, held_out: Column | None = None, *, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE,
) -> Model:
    """Fits a model on a bounded sample of the labelled rows outside ``held_out``."""
    held_out = held_out_fold(F.col(id_col)) if held_out is None else held_out
    sample = training_sample(
        docs, held_out, id_col=id_col, text_col=text_col, lang_col=lang_col,
        per_language=per_language,
    )
    return fit([text for _, text in sample], [lang for lang, _ in sample])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score.

    A text that is NULL or has no letter gets ``und`` and score 0, as does every text when the
    model has seen no language. Whole texts are read. Columns of ``docs`` named lang_pred or
    score are replaced; others, whatever their names, pass through.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = kept.index(text_col)
    schema = T.StructType([docs.schema[c] for c in kept] + _RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small slices, so that long texts are not all held as Python strings at once.
            for at in range(0, batch.num_rows, 8 * ROWS):
                part = batch.slice(at, 8 * ROWS)
                names, sure = shared.value.predict(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())],
                    names=schema.names,
                )

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
