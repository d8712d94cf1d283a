"""Word shingles of whole texts as sorted sets of 64-bit hashes, vectorised over many texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

# Texts are hashed in blocks of about this many bytes, so memory does not follow their length.
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    """A random value per byte; upper-case A-Z as their lower case, white space as 0."""
    values = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    values[[9, 10, 11, 12, 13, 32]] = 0
    return values


_VALUES = _byte_values()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a block."""
    values = _VALUES[np.frombuffer(block, np.uint8)]
    inside = values != 0
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    place = np.arange(starts[0], len(values)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _STEP)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    hashed = np.add.reduceat(values[starts[0]:] * powers[place], starts - starts[0])
    return starts, mix(hashed)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at white space."""
    at = 0
    while len(text) - at > BLOCK:
        found = _SPACE.search(text, at + BLOCK)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The words' hashes of each text, in order; words are runs without ASCII white space."""
    batch: list[bytes] = []
    size = 0
    for text in texts:
        if size and size + len(text) > BLOCK:
            yield from _joined(batch)
            batch, size = [], 0
        if len(text) > BLOCK:
            yield np.concatenate([_hash_words(p)[1] for p in _pieces(text)])
        else:
            batch.append(text)
            size += len(text) + 1
    if batch:
        yield from _joined(batch)


def _joined(batch: list[bytes]) -> Iterator[np.ndarray]:
    starts, hashes = _hash_words(b"\n".join(batch))
    ends = np.cumsum([len(t) + 1 for t in batch])
    cuts = np.searchsorted(starts, ends)
    low = 0
    for high in cuts:
        yield hashes[low:high]
        low = high


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words is one shingle."""
    for words in word_hashes(texts):
        n = len(words)
        if n == 0:
            yield words
            continue
        w = min(width, n)
        total = np.full(n - w + 1, w, np.uint64)
        for i in range(w):
            total += words[i:n - w + 1 + i] * _FACTORS[i]
        yield np.unique(mix(total))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as signed ones in the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart whatever order their members come in."""
    total = values.sum(dtype=np.uint64)
    crossed = np.bitwise_xor.reduce(mix(values + _STEP)) if len(values) else np.uint64(0)
    return int(np.array(total).view(np.int64)), int(np.array(crossed).view(np.int64))
