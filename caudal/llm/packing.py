"""Concatenate and cut: documents' tokens end to end, cut into windows of one fixed length.

Pass one tokenises and gives each document its offset inside its partition. The partitions'
token totals are then summed in order, which gives every partition, and so every document, its
global offset. Pass two cuts at the multiples of the window length; a document that crosses a
boundary becomes several pieces. No row depends on another row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from caudal.llm.common import stored

WORD_BPE = "word_bpe_49k.json"
END_OF_DOCUMENT = 2
WINDOW_TOKENS = 4096
# A worker forgets its cached words beyond this many (about 150 MB).
CACHED_WORDS = 800_000
_LOWER_OR_DIGIT = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

_TOKENS = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("local_offset", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


# Lower-case letters of ASCII and Latin-1 in UTF-8.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# Byte-level tokenizers show the n-th byte that Latin-1 has no mark for as character 256 + n.
_UNSEEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_SHOWN = {byte: 256 + n for n, byte in enumerate(_UNSEEN)}
# Texts cut into words at a time.
_STEP = 100


def _words(text: bytes) -> list[bytes]:
    if not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
        text = text.lower()
    return text.split()


class _Known(dict):
    """Ids of words. A word asked for first gets a buffer, to be filled before it is read."""

    def __init__(self) -> None:
        super().__init__()
        self.asked: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        self[word] = self.asked[word] = buffer = bytearray()
        return buffer


class WordCache:
    """Token ids of white-space separated words, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no token spans it, so a text's ids are its words' ids
    in order, and each distinct word is encoded once. Only ASCII white space separates here;
    other white space stays inside a word and is left to the tokenizer. The tokenizer
    lower-cases, and keeps letters and digits apart from a mark behind them: lower-casing
    beforehand and taking a last full stop or comma by itself leaves fewer words to encode.
    Lower-casing is not done where it could change the ids, that is beside combining marks, which
    would compose with other letters, and in texts that hold special tokens.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known = _Known()
        known = self.known.__getitem__
        for at in range(0, len(texts), _STEP):
            cut = [list(map(known, _words(text))) for text in texts[at:at + _STEP]]
            self._learn()
            for ids in cut:
                yield b"".join(ids)

    def _learn(self) -> None:
        """Fills the buffers of all words asked for."""
        known = self.known
        marked = [
            w for w in known.asked if w[-1] in b".," and len(w) > 1 and w[-2] in _LOWER_OR_DIGIT
        ]
        for word in marked:
            known[word[:-1]], known[word[-1:]]
        new, known.asked = known.asked, {}
        for word in marked:
            del new[word]
        buffers, rest, model = [], [], self.tokenizer.model.tokenize
        for word, buffer in new.items():
            # Such letters pass the normaliser and the splitting as they are.
            if _LETTERS.fullmatch(word):
                shown = word.decode("latin-1").translate(_SHOWN)
                buffer += array("I", [t.id for t in model(shown)]).tobytes()
                known[word] = bytes(buffer)
            else:
                rest.append(word)
                buffers.append(buffer)
        if rest:
            found = self.tokenizer.encode_batch_fast(
                [w.decode("utf-8", "replace") for w in rest], add_special_tokens=False
            )
            for word, buffer, encoded in zip(rest, buffers, found, strict=True):
                buffer += array("I", encoded.ids).tobytes()
                known[word] = bytes(buffer)
        for word in marked:
            buffer = known[word]
            buffer += known[word[:-1]] + known[word[-1:]]
            known[word] = bytes(buffer)


_CACHES: dict[str, WordCache] = {}


def _tokenise(path: str, end: int):
    """Arrow batches of (doc_id, text) to batches of ``_TOKENS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _CACHES:
            _CACHES[path] = WordCache(path)
        cache = _CACHES[path]
        part, offset, tail = TaskContext.get().partitionId(), 0, end.to_bytes(4, "little")
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            size = 0
            for doc_id, ids in zip(doc_ids, cache.encode(texts), strict=True):
                ids += tail
                rows.append((part, doc_id, offset, len(ids) // 4, ids))
                offset += len(ids) // 4
                size += len(ids)
                # Long texts: hand on before the output of one input batch grows large.
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        names=_TOKENS.names,
    )


def token_table(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_OF_DOCUMENT,
) -> DataFrame:
    """Pass one, stored: each document's ids and its offset inside its partition."""
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(wanted.mapInArrow(_tokenise(tokenizer_path, end_id), _TOKENS), "tokens")


def pack(
    docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW_TOKENS,
    id_col: str = "doc_id", text_col: str = "text", end_id: int = END_OF_DOCUMENT,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id,
    offset, piece, pieces.

    Every document's ids (with ``end_id`` behind them) lie in exactly one piece each; sequences
    are full but for the last one, which alone needs padding. A NULL or empty text is one
    piece holding ``end_id``; rows repeated or without a doc_id are packed like any other; other
    columns are not looked at; an empty table gives no rows. The order of documents is the
    order in which Spark's partitions hold them.
    """
    tokens = token_table(
        docs, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id
    )
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row per partition of the first pass, so this window and the broadcast hold as many
    # short rows as that pass had tasks, however many documents there are.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    begin = F.col("base") + F.col("local_offset")
    windows = F.expr(f"sequence(begin div {window}, (begin + doc_tokens - 1) div {window})")
    pieces = (
        tokens.join(F.broadcast(bases), "part")
        .withColumn("begin", begin)
        .withColumn("windows", windows)
        .select("*", F.posexplode("windows").alias("piece", "sequence_id"))
        .withColumn("from_", F.greatest(F.col("begin"), F.col("sequence_id") * window))
        .withColumn(
            "to_",
            F.least(F.col("begin") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * window),
        )
        .withColumn("start", F.col("from_") - F.col("begin"))
        .withColumn("length", F.col("to_") - F.col("from_"))
    )
    ids = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return pieces.select(
        "doc_id", "start", "length", ids.alias("ids"), F.crc32(ids).alias("ids_crc32"),
        "doc_tokens", "sequence_id",
        (F.col("from_") - F.col("sequence_id") * window).alias("offset"),
        "piece", F.size("windows").alias("pieces"),
    )
