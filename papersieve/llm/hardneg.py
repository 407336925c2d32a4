"""Hard negatives of anchors by a secondary sort: scores in descending order, read as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import matrix, products

BLOCK = 16_384
"""Rows of a block (about); every block meets all anchors in one task."""
AT_ONCE = 64
"""Anchors scored at once against a block."""
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
"""A negative's score is from ``LOW`` to ``HIGH`` hundredths of its positive's."""


def _largest(scores: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column of the largest score of each row, then the next; the first column of equal ones. Overwrites."""
    rows = np.arange(len(scores))
    for _ in range(min(count, scores.shape[1])):
        best = scores.argmax(1)
        there = scores[rows, best] > -np.inf
        yield rows[there], best[there]
        scores[rows, best] = -np.inf


class _Block:
    """The rows of one block, in ascending order of their ids, nulls last."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids, self.rows = table["vec_id"].to_pylist(), table["row"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.vectors = matrix(table["vector"].combine_chunks())

    def scored(self, anchors: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For some anchors at a time: first, end, their scores with all rows, and which rows share their label."""
        labels = anchors.column("label").to_numpy()
        vectors = matrix(anchors.column("vector"))
        for first in range(0, len(labels), AT_ONCE):
            end = min(first + AT_ONCE, len(labels))
            scores = products(vectors[first:end], self.vectors)
            if scores.dtype.kind == "i":  # exact, but without an infinity to rule rows out by
                scores = scores.astype(np.longdouble)
            yield first, end, scores, labels[first:end, None] == self.labels

    def positives(self, anchors: pa.RecordBatch, count: int) -> Iterator[tuple[int, int, int]]:
        """Anchor (its place), score and row of the best rows of the same label but for the anchor itself."""
        own = anchors.column("row").to_numpy()
        for first, end, scores, same in self.scored(anchors):
            wanted = np.where(same & (own[first:end, None] != self.rows), scores, -np.inf)
            for at, best in _largest(wanted, count):
                yield from zip((first + at).tolist(), map(int, scores[at, best]), best.tolist(), strict=True)

    def negatives(self, anchors: pa.RecordBatch, count: int) -> Iterator[tuple[int, int, int]]:
        """Anchor, score and row of the best rows of other labels within the window of each positive."""
        windows = anchors.column("positive_scores").to_pylist()
        for first, end, scores, same in self.scored(anchors):
            most = max(map(len, windows[first:end]), default=0)
            seen = np.zeros(scores.shape, bool)
            for i in range(most):
                # no window: from 1 down to 0
                ends = [window(w[i]) if i < len(w) else (1, 0) for w in windows[first:end]]
                low, high = np.array(ends, scores.dtype).T[:, :, None]
                wanted = np.where(~same & (scores >= low) & (scores <= high), scores, -np.inf)
                for at, best in _largest(wanted, count):
                    seen[at, best] = True
            at, best = np.nonzero(seen)
            yield from zip((first + at).tolist(), map(int, scores[at, best]), best.tolist(), strict=True)


def window(score: int) -> tuple[int, int]:
    """The least and the greatest whole score that is a hard negative beside a positive of ``score``."""
    return -(-LOW * score // 100), HIGH * score // 100


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, choose: str, count: int) -> DataFrame:
    """``anchor``, ``anchor_id``, ``score``, ``vec_id``: the best of each block for each anchor.

    Rows are dealt to blocks; every anchor goes to each. A block is sorted so that its rows come before the
    anchors, which are then read as a stream and never held.
    """
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    scores = F.lit(None).cast("array<bigint>")
    columns = ["block", "is_anchor", "row", "vec_id", "label", "vector", "positive_scores"]
    dealt = rows.withColumns({"block": block, "is_anchor": F.lit(False), "positive_scores": scores}).select(columns)
    asked = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "is_anchor": F.lit(True)})
    both = dealt.unionByName(asked.select(columns)).repartitionById(blocks, F.col("block"))
    ordered = both.sortWithinPartitions("block", "is_anchor", F.col("vec_id").asc_nulls_last())
    schema = "anchor bigint, anchor_id bigint, score bigint, vec_id bigint"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, ready = None, None
        for batch in batches:
            # a run: rows of one block and one kind
            kind = batch.column("block").to_numpy() * 2 + batch.column("is_anchor").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for first, end in zip(edges, edges[1:], strict=False):
                if first == end:
                    continue
                part = batch.slice(first, end - first)
                if kind[first] // 2 != now:
                    now, held, ready = kind[first] // 2, [], None
                if kind[first] % 2 == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # no rows fell into this block
                ready = ready or _Block(held)
                found = list(getattr(ready, choose)(part, count))
                at = [f[0] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row").take(pa.array(at, pa.int64())),
                        part.column("vec_id").take(pa.array(at, pa.int64())),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([ready.ids[f[2]] for f in found], pa.int64()),
                    ],
                    ["anchor", "anchor_id", "score", "vec_id"],
                )

    return ordered.mapInArrow(met, schema)


def _streamed(count: int):
    """Reads scores by anchor, descending; positives open windows, which negatives fill up to ``count``."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for batch in batches:
            out: list[tuple] = []
            for row, anchor_id, score, positive, vec_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != anchor:
                    anchor, windows = row, []
                if positive:
                    windows.append([*window(score), vec_id, score, 0])
                    continue
                for w in windows:
                    if w[0] <= score <= w[1] and w[4] < count:
                        w[4] += 1
                        out.append((anchor_id, w[2], w[4], vec_id, w[3], score))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))],
                    ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
                )

    return streamed


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK
) -> DataFrame:
    """Hard negatives for the positives of each anchor among ``vectors`` (``vec_id``, ``label``, ``vector``).

    ``vector`` holds whole numbers, none of them null; ``label`` is never null.
    A score is the inner product with the anchor; higher ones come first, equal
    ones by ``vec_id``, nulls last. Rows that satisfy ``is_anchor`` are anchors.
    An anchor's positives are its first ``positives`` other rows of the same
    label. Of the rows of other labels whose score is from ``LOW`` to ``HIGH`` hundredths of
    the positive's, the first ``negatives`` are returned, a row each:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Every row counts as one of its own, also where rows or ids repeat. Shorter
    vectors are taken as if zeros followed. An empty table, an anchor without
    positives and a positive without negatives give no rows; other columns are ignored.

    All rows are scored against all anchors, in blocks of about ``block`` rows,
    twice: once for the positives, once for the negatives that their windows admit. A block hands on
    its best ``positives`` rows for an anchor and its best ``negatives`` rows for each window: the first ones of all blocks
    are among them. Those scores are sorted by (anchor, descending score,
    positives first, id) and read as a stream, in which a positive opens its window and
    later rows fill it; an anchor's scores are never held together.
    """
    rows = stored(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"), "vector",
        F.coalesce(is_anchor, F.lit(False)).alias("chosen"),
    ))
    blocks = max(1, -(-rows.count() // block))
    anchors = rows.where("chosen").drop("chosen")
    rows = rows.drop("chosen")
    best = _met(rows, anchors.withColumn("positive_scores", F.lit(None).cast("array<bigint>")), blocks, "positives", positives)
    descending = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = stored(best.withColumn("place", F.row_number().over(descending)).where(F.col("place") <= positives))
    opened = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("positive_scores"))
    rest = _met(rows, anchors.join(opened, "row"), blocks, "negatives", negatives)
    scores = best.withColumn("positive", F.lit(True)).drop("place").unionByName(rest.withColumn("positive", F.lit(False)))
    ordered = (
        scores.repartition("anchor")
        .sortWithinPartitions("anchor", F.desc("score"), F.desc("positive"), F.col("vec_id").asc_nulls_last())
        .select("anchor", "anchor_id", "score", "positive", "vec_id")
    )
    return ordered.mapInArrow(
        _streamed(negatives),
        "anchor_id bigint, positive_id bigint, `rank` int, negative_id bigint, positive_score bigint, negative_score bigint",
    )
