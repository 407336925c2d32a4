"""Packing by bounded-space best fit: a fixed number of open windows in each partition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import default_path, tokenizer

LENGTH = 2048
OPEN = 32
LEAST_CUT = 64
"""A window is topped up with the beginning of a document only where at least so many tokens fit."""
END_OF_DOCUMENT = 1
MERGED = 64
"""Partitions whose open windows are merged together at the end; a power of two."""

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "at", "still_open")


class Packer:
    """Open windows of one partition; ``place`` returns the window and offset of each piece of a document."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN, least_cut: int = LEAST_CUT):
        self.length, self.most_open, self.least_cut = length, most_open, least_cut
        self.used: dict[int, int] = {}
        self._next = 0

    def _open(self) -> int:
        self._next += 1
        self.used[self._next - 1] = 0
        return self._next - 1

    def place(self, tokens: int) -> list[tuple[int, int, int, int]]:
        """Pieces ``(start, length, window, offset)`` of a document of ``tokens`` tokens."""
        out, start = [], 0
        while tokens - start >= self.length:  # whole windows never stay open
            window = self._open()
            del self.used[window]
            out.append((start, self.length, window, 0))
            start += self.length
        while start < tokens:
            rest = tokens - start
            fits = [(self.length - u, w) for w, u in self.used.items() if self.length - u >= rest]
            if fits:
                _, window = min(fits)
                size = rest
            elif len(self.used) < self.most_open:
                window, size = self._open(), rest
            else:  # emit the fullest, topped up if that is worth a cut
                gap, window = min((self.length - u, w) for w, u in self.used.items())
                size = min(gap, rest)
                if gap < self.least_cut:
                    del self.used[window]
                    continue
            out.append((start, size, window, self.used[window]))
            self.used[window] += size
            if self.used[window] == self.length:
                del self.used[window]
            start += size
        return out


def _pack(path: str, length: int, most_open: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokenizer(path).ids, Packer(length, most_open)
        base = TaskContext.get().partitionId() << 32
        end = np.array([END_OF_DOCUMENT], "<u4").tobytes()
        held: dict[int, list[tuple]] = {}

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:7]]
                + [pa.array([r[7] for r in found], pa.bool_())],
                _FIELDS,
            )

        for batch in batches:
            done: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text or "") + end
                for start, size, window, at in packer.place(len(ids) // 4):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    held.setdefault(window, []).append(
                        (doc_id, start, size, crc, len(ids) // 4, base + window, at)
                    )
            for window in [w for w in held if w not in packer.used]:
                done += [(*r, False) for r in held.pop(window)]
            if done:
                yield rows(done)
        left = [(*r, True) for found in held.values() for r in found]
        if left:
            yield rows(left)

    return packed


def merge(windows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Lay left-over windows (``window``, ``used``) together, largest first, each where it fits best."""
    free: list[list[int]] = []  # room, sequence
    out = []
    for used, window in sorted(zip(windows["used"], windows["window"], strict=True), key=lambda x: (-x[0], x[1])):
        fits = [f for f in free if f[0] >= used]
        into = min(fits) if fits else [length, window]
        if not fits:
            free.append(into)
        out.append((window, into[1], length - into[0]))
        into[0] -= used
    return pd.DataFrame(out, columns=["window", "into", "shift"])


def pack(
    documents: DataFrame, path: str | None = None, length: int = LENGTH, most_open: int = OPEN
) -> DataFrame:
    """Sequences of at most ``length`` tokens from whole ``documents`` (``doc_id``, ``text``).

    A document is its ids and ``END_OF_DOCUMENT``; null text is empty, and a
    repeated row is a document of its own. Returns a row per piece: ``doc_id``,
    ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Each partition keeps ``most_open`` windows open. A piece goes where it
    leaves least room; if it fits nowhere the fullest window is emitted, topped
    up with the beginning of the piece where at least ``LEAST_CUT`` tokens fit.
    The windows that are open when partitions end are merged whole, those of
    ``MERGED`` partitions in a task. Texts are never shuffled. Token ids are
    those of the tokenizer file ``path``, which must be there on each executor.
    """
    pieces = stored(
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            _pack(path or default_path(), length, most_open),
            f"{PIECE}, window bigint, at bigint, still_open boolean",
        )
    )
    left = (
        pieces.where("still_open").groupBy("window").agg(F.sum("length").alias("used"))
        .withColumn("together", F.shiftright("window", 32 + MERGED.bit_length() - 1))
    )
    merged = left.groupBy("together").applyInPandas(
        lambda rows: merge(rows, length), "window bigint, into bigint, shift bigint"
    )
    closed = pieces.where("NOT still_open").withColumns({"sequence_id": F.col("window"), "offset": F.col("at")})
    opened = (
        pieces.where("still_open").join(merged, "window")
        .withColumns({"sequence_id": F.col("into"), "offset": F.col("at") + F.col("shift")})
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return closed.select(columns).unionAll(opened.select(columns))
