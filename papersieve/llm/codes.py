"""Short codes for vectors: each part becomes the index of the nearest entry of its codebook."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix

PARTS = 8
ENTRIES = 16
ROUNDS = 6
LARGEST = 1 << 27
"""Components of a larger size are refused: squared distances and their sums must fit 64 bits."""
RUN = 2048
"""Leaves that are taken at once."""
GROUPS = 100_000
"""Groups whose totals are broadcast; with more, both sides are shuffled, hot groups in ``SALT`` shares."""
SALT = 64


class Walk:
    """Visits parts as the leaves of a trie, in lexicographic order and depth first.

    A node is a prefix; it holds the squared distances of that prefix from the
    same prefix of every codebook entry. They are worked out once, from those of
    the node above, however many parts share the prefix. What is kept between
    two leaves is the path to the last one; it is carried from run to run. Parts
    in another order give the same distances and only share less.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self._last: np.ndarray | None = None
        self._path = np.zeros((entries.shape[1] + 1, len(entries)), np.int64)

    def distances(self, parts: np.ndarray) -> np.ndarray:
        """For each part, a row, the squared distance from each entry."""
        out = [self._run(parts[i : i + RUN]) for i in range(0, len(parts), RUN)]
        return np.concatenate(out) if out else np.zeros((0, len(self.entries)), np.int64)

    def _run(self, parts: np.ndarray) -> np.ndarray:
        n, width = parts.shape
        before = np.concatenate((parts[:1] if self._last is None else self._last[None], parts[:-1]))
        differs = np.concatenate((parts != before, np.ones((n, 1), bool)), axis=1)
        fork = differs.argmax(1)  # how much of the path to the leaf before is shared
        if self._last is None:
            fork[0] = 0
        above, node = self._path[:1], np.zeros(n, np.int64)
        path = [above[0]]
        for depth in range(width):
            opens = fork <= depth
            at = np.flatnonzero(opens)
            step = parts[at, depth, None] - self.entries[:, depth]
            here = np.concatenate((self._path[depth + 1, None], above[node[at]] + step * step))
            above, node = here, np.cumsum(opens)  # 0 is the node on the carried path
            path.append(here[node[-1]])
        self._last, self._path = parts[-1], np.array(path)
        return above[node]


def nearest(entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance for each part in any order; the lower index of equal ones."""
    distinct, places = np.unique(parts, axis=0, return_inverse=True)
    distances = Walk(entries).distances(distinct)
    best = distances.argmin(1)
    return best[places.ravel()], distances[np.arange(len(best)), best][places.ravel()]


def _keys(position: int, parts: np.ndarray) -> np.ndarray:
    """Bytes that sort as (position, part) do."""
    shifted = (parts + (1 << 31)).astype(">u4")
    first = np.full((len(parts), 1), position, np.uint8)
    return np.concatenate((first, shifted.view(np.uint8).reshape(len(parts), -1)), axis=1)


def _parts_of(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions and parts of ``_keys``."""
    rows = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(len(keys), -1)
    parts = np.ascontiguousarray(rows[:, 1:]).view(">u4").astype(np.int64) - (1 << 31)
    return rows[:, 0], parts


@dataclasses.dataclass
class Codebooks:
    """``entries[part][entry]`` are the components of an entry."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        """Components of a part."""
        return self.entries.shape[2]

    def cut(self, vectors: pa.Array) -> Iterator[np.ndarray]:
        """The parts of some vectors, one position after the other."""
        whole = matrix(vectors, self.entries.shape[0] * self.width)
        for position in range(len(self.entries)):
            yield whole[:, position * self.width : (position + 1) * self.width]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, comma-joined, by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first_entries(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    size = F.max(F.size("vector")).alias("size")
    largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("largest")
    seen = vectors.agg(size, largest).first()
    if (seen["largest"] or 0) >= LARGEST:
        raise OverflowError(f"components of {LARGEST} and more are not supported")
    width = -(-(seen["size"] or 0) // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    whole = matrix(first["vector"].combine_chunks(), parts * width) if len(first) else np.zeros((0, parts * width), np.int64)
    return Codebooks(whole.reshape(len(whole), parts, width).transpose(1, 0, 2).astype(np.int64))


def distinct_parts(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``key``, ``n``: each distinct part of each position and how often it occurs, in order; stored.

    Copies are counted within each batch before anything is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for position, parts in enumerate(books.cut(batch.column(0))):
                distinct, n = np.unique(parts, axis=0, return_counts=True)
                keys = _keys(position, distinct)
                values = pa.array([row.tobytes() for row in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([values, pa.array(n, pa.int64())], ["key", "n"])

    found = vectors.select("vector").mapInArrow(counted, "key binary, n bigint")
    ranged = found.repartitionByRange("key").groupBy("key").agg(F.sum("n").alias("n"))
    return stored(ranged.sortWithinPartitions("key"))


def _sums(parts: DataFrame, books: Codebooks) -> DataFrame:
    """``position``, ``entry``, ``n`` and ``total`` of each component (``place``) of the parts nearest to an entry."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = books.entries.shape
        totals, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        walks = [Walk(entries) for entries in books.entries]
        for batch in batches:
            positions, leaves = _parts_of(batch.column(0))
            weights = batch.column(1).to_numpy()
            for position in np.unique(positions):
                mine = positions == position
                best = walks[position].distances(leaves[mine]).argmin(1)
                np.add.at(counts[position], best, weights[mine])
                np.add.at(totals[position], best, leaves[mine] * weights[mine, None])
        position, entry = np.nonzero(counts)
        for place in range(shape[2]):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(position, pa.int32()), pa.array(entry, pa.int32()),
                    pa.array(np.full(len(entry), place), pa.int32()),
                    pa.array(counts[position, entry]), pa.array(totals[position, entry, place]),
                ],
                ["position", "entry", "place", "n", "total"],
            )

    found = parts.mapInArrow(summed, "position int, entry int, place int, n bigint, total bigint")
    return found.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks for ``vectors`` (``vec_id``, ``vector`` of whole numbers, none null).

    A position starts from that part of the ``entries`` rows that come first by
    ``vec_id`` (nulls last, then by vector); fewer rows make fewer entries. Each round
    assigns all parts and replaces an entry by the floor of its parts' mean;
    unused ones stay. All rows count, copies as often as they occur. Only sums
    of ``parts * entries`` rows come to the driver. An empty table has no entries.
    """
    books = _first_entries(vectors, parts, entries)
    if not books.entries.size:
        return books
    found = distinct_parts(vectors, books)
    for _ in range(rounds):
        now = books.entries.copy()
        for row in _sums(found, books).collect():
            now[row["position"], row["entry"], row["place"]] = row["total"] // row["n"]
        books = Codebooks(now)
    return books


def compress(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` (``vec_id``, ``label``, ``vector``) as ``vec_id``, ``label``, ``codes`` and ``error``.

    ``codes`` holds the index of the nearest entry for each part, ``error`` the sum of
    their squared distances. One scan without a shuffle; rows stay as they are, repeated ones too.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(books.entries)), np.int32)
            error = np.zeros(batch.num_rows, np.int64)
            if books.entries.size:
                for position, parts in enumerate(books.cut(batch.column(2))):
                    codes[:, position], distance = nearest(books.entries[position], parts)
                    error += distance
            offsets = pa.array(np.arange(batch.num_rows + 1) * codes.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error)],
                ["vec_id", "label", "codes", "error"],
            )

    kept = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "vector")
    return kept.mapInArrow(coded, "vec_id bigint, label bigint, codes array<int>, error bigint")


def with_group_total(rows: DataFrame, group: str, value: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of the same ``group``, nulls together.

    The totals are a row per group. They are broadcast after a count of theirs;
    beyond ``GROUPS`` each is sent to ``SALT`` shares of its rows, so that a hot group is split.
    """
    sums = stored(rows.groupBy(F.col(group).alias("__group")).agg(F.sum(value).alias(total)))
    if sums.count() <= GROUPS:
        return rows.join(F.broadcast(sums), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")
    shares = sums.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("__at", F.pmod(F.xxhash64(*rows.columns), F.lit(SALT)).cast("int"))
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("__at") == F.col("__share"))
    return dealt.join(shares, same).drop("__group", "__share", "__at")
