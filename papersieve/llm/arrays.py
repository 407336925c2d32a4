"""Characters and words of many texts as numpy arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
"""Characters handled at once; a longer text is taken in parts of this length."""

_U = np.uint64
_IS_WORD = np.array([*(chr(i).isalnum() for i in range(128)), True])
_FOLD = np.array([ord(chr(i).lower()) for i in range(128)], np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTORS = mix(np.arange(256, dtype=_U)) | _U(1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(texts: list[str], limit: int = BLOCK, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` characters, and ``rows`` texts at most."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and (size + len(text) > limit or i - first >= rows):
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def text_slices(texts: pa.Array, limit: int = BLOCK) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, in lists of about ``limit`` bytes, so that few are Python strings at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 1)
    first = 0
    while first < len(texts):
        start = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, start + limit, "right")))
        yield texts.slice(first, end - first).to_pylist()
        first = end


def parts(text: str, overlap: int = 0) -> Iterator[str]:
    """A text in parts of ``BLOCK`` characters that share ``overlap`` characters.

    Without overlap, a part ends at white space if it holds any.
    """
    start = 0
    while True:
        end = start + BLOCK
        if end >= len(text):
            yield text[start:]
            return
        if not overlap:
            end = max(text.rfind(" ", start, end), text.rfind("\n", start, end)) + 1 or end
            end = max(end, start + 1)
        yield text[start:end]
        start = end - overlap


class Words:
    """Words of an array of characters: ``[^\\x00-/:-`{-\\x7f]+`` after lower-casing A-Z."""

    def __init__(self, chars: np.ndarray):
        inside = _IS_WORD[np.minimum(chars, 128)]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        self.starts, self.lengths = edges[::2], edges[1::2] - edges[::2]
        kept = chars[inside]
        kept = np.where(kept < 128, _FOLD[np.minimum(kept, 127)], kept)
        self._first = np.cumsum(self.lengths) - self.lengths
        self._offset = np.arange(len(kept)) - np.repeat(self._first, self.lengths)
        self._values = (kept.astype(_U) + _U(1)) * _FACTORS[self._offset & 255]

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        return mix(np.add.reduceat(self._values, self._first) + self.lengths.astype(_U))

    def prefixes(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` characters of every word."""
        if not len(self.starts):
            return np.zeros(0, _U)
        head = np.where(self._offset < length, self._values, _U(0))
        return mix(np.add.reduceat(head, self._first) ^ _U(length << 32))


def word_blocks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive ranges of texts: first, end, hashes of their words, and the text of each word."""
    for first, end in spans(texts):
        if end - first == 1:
            found = [Words(codes(part)).hashes() for part in parts(texts[first])]
            hashes = np.concatenate(found)
            yield first, end, hashes, np.zeros(len(hashes), np.int64)
        else:
            words = Words(codes("\n".join(texts[first:end])))
            sizes = np.array([len(t) + 1 for t in texts[first:end]])
            yield first, end, words.hashes(), np.searchsorted(np.cumsum(sizes), words.starts, "right")


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
