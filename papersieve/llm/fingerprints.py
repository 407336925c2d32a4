"""Fingerprints that tell versions of a document apart: invertible Bloom lookup sketches of its paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, _FACTORS, codes, mix, parts, spans

CELLS = 15
"""Cells of a fingerprint; three tables of a third each."""
GROWTH = 4
"""How much larger the sketches are that are tried next when peeling gets stuck."""
PIECE = 8
"""A paragraph is cut behind one word in so many, chosen by the word itself."""

_U = np.uint64


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the paragraph pieces of whole texts, and the text of each.

    A paragraph is a line; long ones are cut behind words whose hash says so,
    which does not depend on what stands elsewhere. A digest covers every
    character. A piece that a text repeats gets another digest each time.
    """
    found, owners = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for first, end in spans(texts):
        alone = end - first == 1
        sizes = np.cumsum([len(t) + 1 for t in texts[first:end]])
        for chunk in parts(texts[first]) if alone else ["\n".join(texts[first:end])]:
            chars = codes(chunk)
            if not len(chars):
                continue
            words = Words(chars)
            last = words.starts + words.lengths
            ends = np.union1d(np.flatnonzero(chars == 10) + 1, last[words.hashes() % _U(PIECE) == 0])
            starts = np.concatenate(([0], ends[ends < len(chars)])).astype(np.int64)
            lengths = np.diff(np.append(starts, len(chars)))
            offset = np.arange(len(chars)) - np.repeat(starts, lengths)
            rows = starts * 0 if alone else np.searchsorted(sizes, starts, "right")
            values = (chars.astype(_U) + _U(1)) * (_FACTORS[offset & 255] + (offset >> 8).astype(_U) * _U(2))
            if not alone:  # the breaks between texts belong to none of them
                values[sizes[:-1] - 1] = 0
            pieces = np.add.reduceat(values, starts)
            some = pieces != 0
            found.append(mix(pieces)[some])
            owners.append(rows[some] + first)
    key, row = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))[: len(key)]
    at = np.arange(len(key))
    time = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(time > 0, mix(key + time.astype(_U)), key), row


class Sketches:
    """A sketch of ``cells`` cells for each of ``n`` sets of digests: count, sum of digests, sum of checks."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.keys, self.checks = np.zeros(n * cells, _U), np.zeros(n * cells, np.uint32)

    def _at(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        third = self.cells // 3
        return np.concatenate([
            rows * self.cells + i * third + (mix(keys ^ _U(i + 3 * self.cells)) % _U(third)).astype(np.int64) for i in range(3)
        ])

    def add(self, keys: np.ndarray, rows: np.ndarray, sign: np.ndarray | int = 1) -> None:
        """Add digests to the sketches of their rows; with sign -1, take them away."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        at, times = self._at(keys, rows), np.tile(sign, 3)
        factor = times.view(_U) if times.flags.c_contiguous else np.ascontiguousarray(times).view(_U)
        np.add.at(self.count, at, times)
        np.add.at(self.keys, at, np.tile(keys, 3) * factor)
        np.add.at(self.checks, at, (np.tile(_check(keys), 3).astype(np.int64) * times).astype(np.uint32))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover the digests: digest, row and sign of each, and which rows came out empty, that is complete."""
        keys, rows, signs = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            sign = self.count[at]
            key = self.keys[at] * sign.view(_U)
            pure = (self.checks[at].astype(np.int64) * sign).astype(np.uint32) == _check(key)
            at, key, sign = at[pure], key[pure], sign[pure]
            row = at // self.cells
            _, once = np.unique(np.stack([key, row.astype(_U)]), axis=1, return_index=True)
            key, row, sign = key[once], row[once], sign[once]
            if not len(key):
                break
            self.add(key, row, -sign)
            keys.append(key), rows.append(row), signs.append(sign)
            touched = np.unique(self._at(key, row))
            at = touched[np.abs(self.count[touched]) == 1]
        empty = ~((self.count != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.n, self.cells).any(1)
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(signs), empty

    def strings(self, sizes: np.ndarray) -> list[str]:
        packed = np.concatenate([
            a.astype(t).reshape(self.n, -1).view(np.uint8)
            for a, t in ((self.count, "<i4"), (self.keys, "<u8"), (self.checks, "<u4"))
        ], axis=1)
        return [f"{n}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(sizes, packed, strict=True)]


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32)


def differences(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests in which ``n`` pairs of sets differ: digest, pair, and 1 (left only) or -1 (right only).

    Sketches of both sides are subtracted and peeled; pairs that get stuck are
    tried again with sketches ``GROWTH`` times as large, until none is left.
    """
    out = [[np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    todo = np.arange(n)
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        sketch = Sketches(len(todo), cells)
        for (keys, rows), sign in ((left, 1), (right, -1)):
            mine = place[rows] >= 0
            sketch.add(keys[mine], place[rows[mine]], sign)
        keys, rows, signs, empty = sketch.peel()
        done = empty[rows]
        for part, values in zip(out, (keys[done], todo[rows[done]], signs[done]), strict=True):
            part.append(values)
        todo, cells = todo[~empty], cells * GROWTH
    return tuple(np.concatenate(part) for part in out)


def likeness(left: tuple, right: tuple, n: int) -> np.ndarray:
    """Share of common digests among all digests of ``n`` pairs, by the differences that come out of their sketches."""
    _, rows, signs = differences(left, right, n)
    a, b = (np.bincount(side[1], minlength=n) for side in (left, right))
    common = a - np.bincount(rows[signs > 0], minlength=n)
    return np.where(a + b > 0, common / np.maximum(a + b - common, 1), 1.0)


def fingerprint(texts: list[str]) -> list[str]:
    """Number of paragraph pieces and the sketch of each text; equal for equal texts."""
    keys, rows = paragraphs(texts)
    sketch = Sketches(len(texts), CELLS)
    sketch.add(keys, rows)
    return sketch.strings(np.bincount(rows, minlength=len(texts)))


_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all ``texts`` but the last; each is compared with the one after it."""
    own, n = texts[:-1], len(texts) - 1
    quarters = [len(t) // 4 for t in own]
    edited = [t[: len(t) - q] + after[:q] for t, q, after in zip(own, quarters, texts[1:], strict=True)]
    keys, rows = paragraphs(texts)
    left = keys[rows < n], rows[rows < n]
    following = keys[rows > 0], rows[rows > 0] - 1
    changed = paragraphs(edited)
    strings = []
    for k, r in (left, changed):
        sketch = Sketches(n, CELLS)
        sketch.add(k, r)
        strings.append(sketch.strings(np.bincount(r, minlength=n)))
    columns = [
        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array(strings[0], pa.string()), pa.array(strings[1], pa.string()),
        pa.array(likeness(left, changed, n)), pa.array(likeness(left, following, n)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SCHEMA.split(", ")])


def compare_with_next(documents: DataFrame) -> DataFrame:
    """Fingerprints of each of ``documents`` (``doc_id``, ``text``) and its edited text, and two likenesses.

    The edited text has the last quarter of the code points (rounded down)
    replaced by the first as many of the next document in order of ``doc_id``,
    the first after the last. Null text is empty; a null ``doc_id`` comes before all
    others; rows of one ``doc_id`` follow their texts; a single document is its own next.

    Texts are dealt into ranges of ``doc_id`` once. The first document of a range
    is also sent to the range before it, so that each range is worked on alone.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    keyed = documents.select(key.alias("key"))
    ranges = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / ranges for i in range(1, ranges)]
    bounds = sorted({int(b) for b in keyed.approxQuantile("key", steps, 0.2 / ranges)})

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(), "left").astype(np.int32))

    firsts = sorted(
        (row[0], row[1]) for row in keyed.groupBy(range_of(F.col("key"))).agg(F.min("key")).collect()
    )  # one row for each range
    before = {least: firsts[i - 1][0] for i, (_, least) in enumerate(firsts)}

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array) -> pa.Array:
        own = np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(), "left")
        return pa.array(
            [[int(o), before[k]] if k in before else [int(o)] for o, k in zip(own, keys.to_pylist(), strict=True)],
            pa.list_(pa.int32()),
        )

    dealt = (
        documents.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        .select("*", F.posexplode(places(F.col("key"))).alias("borrowed", "range"))
        .repartition("range")
        .sortWithinPartitions("range", "borrowed", "key", "text")
        .select("range", "borrowed", "doc_id", "text")
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, which waits for the next one
        for batch in batches:
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for first, end in spans([r[3] for r in rows]):
                block = rows[first : end + 1]
                start = 0
                for i in range(1, len(block) + 1):
                    if i == len(block) or block[i][0] != block[start][0] or block[i - 1][1] == 1:
                        run = block[start:i]
                        if len(run) > 1:
                            yield _compare([r[2] for r in run], [r[3] for r in run])
                        start = i
            held = rows[-1:]

    return dealt.mapInArrow(compared, _SCHEMA)
