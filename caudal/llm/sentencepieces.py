"""SentencePiece encoding and decoding with forward states shared along common prefixes.

A text is cut into marked words (a word with the white-space marks before it); no piece spans
two. The distinct words of a batch are sorted, which is their trie in depth-first order, and
the forward recursion over a word's characters starts where it leaves the word before: states
of a common prefix are computed once.

The model is of the BPE kind, for which the segmentation of the highest score sum is not the
right result. The recursion therefore carries, for each prefix, the last piece of the prefix's
own encoding instead of a score: piece ``t`` ends prefix ``i`` if it may follow the last piece
of the prefix before it, that is, if merging both texts from characters gives those two pieces
again. A word's encoding is then read backwards, as in Viterbi's algorithm. The ids equal those
of the sentencepiece library.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
# Words of one generation of a worker's cache, and pairs whose compatibility it remembers.
CACHED_WORDS = 400_000
CACHED_PAIRS = 300_000
_MARKED = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """The model's vocabulary and the recursion over it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.unknown = model.unk_id()
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        plain = [
            i for i in range(size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        # How long pieces are that end in two given characters, and 1; only one length fits, so
        # those that most pieces have are tried first.
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], {1}).add(len(piece))
        usual = {2: 0, 3: 1, 4: 2, 1: 3}
        self.sizes = {
            end: tuple(sorted(found, key=lambda n: usual.get(n, n))) for end, found in lengths.items()
        }
        self.grown: dict[str, tuple[list[str], list[str]] | None] = {}
        # What each id stands for when decoding; marks are spaces.
        self.texts = [b""] * size
        for piece, i in self.ids.items():
            self.texts[i] = piece.replace(MARK, " ").encode()
        for byte, i in self.bytes.items():
            self.texts[i] = bytes([byte])
        self.texts[self.unknown] = " ⁇ ".encode()
        self.table = np.array([*self.texts, b""], object)[:-1]
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merges from characters: always the pair whose whole scores highest, the first of equals."""
        parts = list(text)
        while (at := self._best(parts)) >= 0:
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _best(self, parts: list[str]) -> int:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = self.scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        return at

    def spines(self, piece: str) -> tuple[list[str], list[str]] | None:
        """What its first and its last character belonged to while a piece was merged; None
        where merging never gives the piece."""
        if piece not in self.grown:
            parts, first, last = list(piece), [piece[0]], [piece[-1]]
            while (at := self._best(parts)) >= 0:
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                if parts[0] != first[-1]:
                    first.append(parts[0])
                if parts[-1] != last[-1]:
                    last.append(parts[-1])
            self.grown[piece] = (first, last) if len(parts) == 1 else None
        return self.grown[piece]

    def follows(self, left: str, right: str) -> bool:
        """Whether ``right`` may stand behind ``left``: whether merging both texts together
        from characters gives these two. Without ``left``, whether ``right`` is ever reached.

        A merge across the border must never come first. Both sides grow as they do alone, the
        higher score first; at each state the two parts that meet must not score higher.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._follows(left, right)
        return known

    def _follows(self, left: str, right: str) -> bool:
        begins = self.spines(right)
        if not left or begins is None:
            return begins is not None
        if left[-1] == right[0] == MARK:
            # Runs of marks all score the same, so their order is that of their places.
            return self.merged(left + right) == [left, right]
        ends = self.spines(left)
        if ends is None:
            return False
        x, y, scores = ends[1], begins[0], self.scores
        i = j = 0
        while True:
            grown_left = scores[x[i + 1]] if i + 1 < len(x) else None
            grown_right = scores[y[j + 1]] if j + 1 < len(y) else None
            across = scores.get(x[i] + y[j])
            if across is not None:
                # Of equal scores the merge further left comes first.
                if grown_left is not None and grown_left >= across:
                    pass
                elif grown_right is None or grown_right <= across:
                    return False
            if grown_left is None and grown_right is None:
                return True
            if grown_right is None or (grown_left is not None and grown_left >= grown_right):
                i += 1
            else:
                j += 1

    def forward(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of each of the sorted ``words``, in their order."""
        ids, sizes, pairs, follows = self.ids, self.sizes, self.pairs, self.follows
        before, last = "", [""]
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                for n in sizes.get(word[end - 2:end] if end > 1 else word[0], _ONE):
                    if n > end:
                        continue
                    piece = word[end - n:end]
                    # A single character may always stand; what it lacks are bytes, below.
                    if n == 1 or piece in ids:
                        left = last[end - n]
                        fits = pairs.get((left, piece))
                        if fits or (fits is None and follows(left, piece)):
                            last.append(piece)
                            break
                else:
                    raise AssertionError(f"no piece ends {word[:end]!r}")
            before = word
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            yield pieces[::-1]

    def spelled(self, piece: str) -> bytes:
        """Little-endian 32-bit ids of a piece, or of its bytes where it is none."""
        found = self.packed.get(piece)
        if found is None:
            if piece in self.ids:
                ids = [self.ids[piece]]
            elif self.bytes:
                ids = [self.bytes[b] for b in piece.encode("utf-8", "replace")]
            else:
                ids = [self.unknown]
            found = self.packed[piece] = struct.pack(f"<{len(ids)}i", *ids)
        return found

    def learn(self, words: set[str]) -> None:
        """Makes sure that ``words`` are known. The cache has two generations: words that are
        met again move to the young one, the others go when that is full."""
        if len(self.words) > CACHED_WORDS:
            self.old, self.words = self.words, {}
        young, old, spelled = self.words, self.old, self.spelled
        missing = words.difference(young)
        young.update({w: old[w] for w in missing.intersection(old)})
        # Words of plain texts come without their one mark.
        marked = sorted([(w if w[:1] == MARK else MARK + w, w) for w in missing.difference(old)])
        for (_, word), pieces in zip(marked, self.forward([m for m, _ in marked]), strict=True):
            young[word] = b"".join([spelled(p) for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut = [marked_words(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.words
        return [b"".join([known[w] for w in words]) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.table[ids].tolist()).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def marked_words(text: str) -> list[str]:
    """Words with their marks, a mark being put before the text; or, where each word has just
    the one, the words without it."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return _MARKED.findall(MARK + text.replace(" ", MARK))


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    """One vocabulary and word cache per worker and model."""
    return Pieces(path)


_STEP = 500
_ONE = (1,)


_IDS = T.ArrayType(T.IntegerType())


def _encoder(model_path: str, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                texts = batch.column(place).to_pylist()
                found = pieces.encode([t or "" for t in texts])
                ids = pa.array(
                    [None if t is None else np.frombuffer(f, "<i4") for t, f in zip(texts, found, strict=True)],
                    pa.list_(pa.int32()),
                )
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=names)

    return run


def _decoder(model_path: str, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, _STEP):
                batch = whole.slice(at, _STEP)
                ids = batch.column(place)
                offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy()
                texts = [
                    pieces.decode(values[a:b]) if known else None
                    for a, b, known in zip(offsets[:-1], offsets[1:], ids.is_valid().to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return run


def _without(df: DataFrame, new: list[str]) -> tuple[DataFrame, list[str]]:
    kept = [c for c in df.columns if c not in new]
    return df.select(*[F.col(f"`{c}`") for c in kept]), kept


def encode(
    docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "piece_ids"
) -> DataFrame:
    """``docs`` with the ids of each whole text. NULL stays NULL, an empty text has no ids.

    A column named like ``ids_col`` is replaced, all others pass through.
    """
    rows, kept = _without(docs, [ids_col])
    schema = T.StructType([*rows.schema.fields, T.StructField(ids_col, _IDS)])
    return rows.mapInArrow(_encoder(model_path, kept.index(text_col), schema.names), schema)


def decode(
    encoded: DataFrame, model_path: str, *, ids_col: str = "piece_ids", text_col: str = "decoded"
) -> DataFrame:
    """``encoded`` with the text of each row's ids; NULL stays NULL, no ids are an empty text.

    Bytes that are no UTF-8 become U+FFFD. A column named like ``text_col`` is replaced.
    """
    rows, kept = _without(encoded, [text_col])
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])
    return rows.mapInArrow(_decoder(model_path, kept.index(ids_col), schema.names), schema)


def encode_and_decode(
    docs: DataFrame, model_path: str, *, text_col: str = "text", ids_col: str = "piece_ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass, without moving the ids in between."""
    rows, kept = _without(docs, [ids_col, decoded_col])
    schema = T.StructType([
        *rows.schema.fields, T.StructField(ids_col, _IDS), T.StructField(decoded_col, T.StringType()),
    ])
    there = _encoder(model_path, kept.index(text_col), [*kept, ids_col])
    back = _decoder(model_path, len(kept), schema.names)
    return rows.mapInArrow(lambda batches: back(there(batches)), schema)
