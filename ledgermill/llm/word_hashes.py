"""Hashes of words and of runs of words, straight from the bytes of a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000  # texts are hashed together up to about so many bytes
_SPACES = "\t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def spaced_words(text: str | None) -> list[str]:
    """Words between spaces and the ASCII controls 9 to 13."""
    text = text or ""
    for space in _SPACES:
        text = text.replace(space, " ")
    return [word for word in text.split(" ") if word]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values, each times its place's inverse power; of all beginnings."""
    room = 1 << max(16, len(values).bit_length())
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _powers(int(_INVERSE), room)[: len(values)], out=out[1:])
    return out


def _between(prefix: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of the values from begins to ends, wherever they stand."""
    room = 1 << max(16, (len(prefix) - 1).bit_length())
    return (prefix[ends] - prefix[begins]) * _powers(int(_BASE), room)[np.minimum(begins, room - 1)]


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words: entry i covers words i to i + length - 1."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    begins = np.arange(n)
    return mix(_between(_prefix_sums(hashes), begins, begins + length) + np.uint64(length))


def _hash_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words per text and the hashes of all words; ``offsets`` are the texts' ends in the data."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.uint64)
    inside = ~_IS_SPACE[data]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[offsets] = True
    begins = np.flatnonzero(inside & np.append(True, ~inside[:-1] | breaks[1:-1]))
    ends = np.flatnonzero(inside & np.append(~inside[1:] | breaks[1:-1], True)) + 1
    found = _between(_prefix_sums(_BYTE[data]), begins, ends)
    return np.diff(np.searchsorted(begins, offsets)), mix(found + (ends - begins).astype(np.uint64))


def sliced(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts, together up to SLICE_BYTES: first text, words per text, word hashes.

    A null text has no words.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, len(texts))
        part = offsets[first : last + 1]
        yield first, *_hash_bytes(data[part[0] : part[-1]], part - part[0])
        first = last


def window_places(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: the places where a whole window fits one text, and which text."""
    fits = np.maximum(sizes - length + 1, 0)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), fits)
    inside = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    return begins[owner] + inside, owner
