"""Vectorised word cutting and hashing over groups of whole texts (used inside Spark tasks).

A word is a maximal run of word bytes of the UTF-8 text. Every byte of a character above U+007F is a word byte,
so byte runs and character runs are the same thing. Words are represented by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts of a group are joined until they hold this many bytes; one longer text is a group of its own.
GROUP_BYTES = 1 << 20


def _table() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (A-Z are lower-cased before).
ALNUM = _table()
_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _MULT, np.uint64)]))


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (first, last + 1) of neighbouring texts with about ``limit`` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and cut into words: (hash, text index, first byte, end byte) of each, in order.

    Byte positions are those in the texts joined by one newline.
    """
    data = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
    inside = ALNUM[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    value = _BYTE[data[inside]] * _powers(int(size.max()))[place]
    h = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return h, np.searchsorted(offsets, start, side="right"), start, end


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words (already lower-cased), equal to those of :func:`cut`."""
    h, which, _, _ = cut([w.encode() for w in words])
    if not np.array_equal(which, np.arange(len(words))):
        raise ValueError("each entry must be exactly one word")
    return h


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is the empty text."""
    return [b"" if t is None else t.encode() for t in column.to_pylist()]
