"""Hashed word shingles of whole texts, computed on arrays of bytes."""

from __future__ import annotations

import numpy as np

_GENERATOR = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; a word's hash is a polynomial of these modulo 2**64.
_BYTE = _GENERATOR.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the step, grown to the longest text met so far."""

    up = _powers(_STEP, 1 << 12)
    down = _powers(_UNSTEP, 1 << 12)

    @classmethod
    def reach(cls, count: int) -> None:
        if count > len(cls.up):
            cls.up = _powers(_STEP, 2 * count)
            cls.down = _powers(_UNSTEP, 2 * count)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of other bytes than 0x20 and 0x09 to 0x0D."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word of the text in order, A to Z lower-cased."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    _Powers.reach(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _Powers.up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _Powers.down[starts])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words.

    A text of fewer words has the whole sequence as its only shingle; one
    without words, or null, has none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * _STEP + words[k : len(words) - width + 1 + k]
        total ^= total >> np.uint64(29)
    return np.unique(mix(total))
