"""Language by the nearest of several centroids per language, over TF-IDF vectors of character n-grams."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import codes, letters, mix, parts, spans
from .common import digest, held_out, stored

DIMENSIONS = 1 << 13
CENTROIDS = 4
SAMPLE = 600
"""Different texts of each language that its centroids are fitted on, at most."""
UNKNOWN = "und"

_U = np.uint64


def _grams(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and bucket of each one, two and three letters in a row; a word has a blank on each side."""
    alphabet = letters()
    c = np.where(alphabet[chars], chars, np.uint32(0)).astype(_U)
    at = np.arange(len(c))
    one = mix(c + _U(1))
    found = [(at[c > 0], one[c > 0])]
    if len(c) > 1:
        two = mix(one[:-1] ^ (c[1:] << _U(32)))
        use = (c[:-1] > 0) | (c[1:] > 0)
        found.append((at[:-1][use], two[use]))
    if len(c) > 2:
        three = mix(two[:-1] ^ (c[2:] << _U(32)) ^ _U(7))
        use = (c[1:-1] > 0)
        found.append((at[:-2][use], three[use]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def count_grams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For consecutive ranges of whole texts: first, end, and a row of n-gram counts for each text."""
    for first, end in spans(texts, rows=256):
        if end - first == 1:
            total = np.zeros((1, DIMENSIONS))
            for part in parts(texts[first].lower(), overlap=2):
                _, buckets = _grams(codes(f" {part} "))
                total[0] += np.bincount((buckets % _U(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
            yield first, end, total
            continue
        lower = [f" {t.lower()} " for t in texts[first:end]]
        at, buckets = _grams(codes("\0".join(lower)))
        ends = np.cumsum([len(t) + 1 for t in lower])
        rows = np.searchsorted(ends, at, "right")
        keys = rows * DIMENSIONS + (buckets % _U(DIMENSIONS)).astype(np.int64)
        yield first, end, np.bincount(keys, minlength=(end - first) * DIMENSIONS).reshape(-1, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a text without letters stays all zero."""
    x = np.log1p(counts, dtype=np.float32) * idf.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


@dataclasses.dataclass
class Centroids:
    """Unit centroids with their languages, and for each the similarity below which a text is rejected."""

    idf: np.ndarray
    languages: list[str]
    matrix: np.ndarray
    floors: np.ndarray

    def nearest(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and rejection of each text; ``und``, 0, true without any letter."""
        out: list[tuple[str, float, bool]] = []
        whole = [t or "" for t in texts]
        for _, _, counts in count_grams(whole):
            if not len(self.languages):
                out += [(UNKNOWN, 0.0, True)] * len(counts)
                continue
            near = vectors(counts, self.idf) @ self.matrix.T
            best = near.argmax(1)
            for i, k, some in zip(range(len(counts)), best, counts.any(1), strict=True):
                score = float(np.clip(near[i, k], 0, 1))
                out.append((self.languages[k], score, score < self.floors[k]) if some else (UNKNOWN, 0.0, True))
        return out


def cluster(x: np.ndarray, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids, and the least usual similarity to each (first percentile less a margin)."""
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        owner = (x @ centres.T).argmax(1)
        means = np.array([x[owner == i].mean(0) if (owner == i).any() else c for i, c in enumerate(centres)])
        centres = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    near = x @ centres.T
    owner = near.argmax(1)
    floors = [
        0.5 * np.quantile(near[owner == i, i], 0.01) if (owner == i).any() else 0.0 for i in range(len(centres))
    ]
    return centres, np.array(floors)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all ``texts`` each bucket occurs, and their number; ``DIMENSIONS`` numbers in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for _, _, counts in count_grams(batch.column(0).to_pylist()):
                total[:DIMENSIONS] += (counts > 0).sum(0)
                total[DIMENSIONS] += len(counts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "texts"])

    found = (
        texts.select("text").mapInArrow(count, "bucket bigint, texts bigint").groupBy("bucket")
        .agg(F.sum("texts").alias("texts")).collect()
    )
    total = np.zeros(DIMENSIONS + 1, np.int64)
    for row in found:
        total[row["bucket"]] = row["texts"]
    return total[:DIMENSIONS], int(total[DIMENSIONS])


def sample_texts(known: DataFrame, bound: int) -> DataFrame:
    """``language, text``: ``bound`` different texts of each language, or all that it has.

    Texts without any letter are left out, and copies count once, so that they
    neither push out the other texts of a language nor fill its sample.
    """
    # unassigned code points may be letters of a later Unicode version
    marked = known.where(F.col("text").rlike(r"[\p{L}\p{Cn}]")).withColumn("text_digest", digest(F.col("text")))
    texts = stored(marked.select("language", "text_digest").distinct())
    sizes = texts.groupBy("language").count()
    place = F.pmod(F.xxhash64("text_digest"), F.lit(1 << 30))
    # twice as many as needed, so that what is numbered per language is small and still enough
    few = texts.join(F.broadcast(sizes), "language").where(place < F.lit(float((1 << 30) * (2 * bound + 100))) / F.col("count"))
    number = F.row_number().over(Window.partitionBy("language").orderBy(place, "text_digest"))
    chosen = few.withColumn("number", number).where(F.col("number") <= bound).select("language", "text_digest")
    return marked.join(F.broadcast(chosen), ["language", "text_digest"]).select("language", "text").distinct()


def train(documents: DataFrame, bound: int = SAMPLE, k: int = CENTROIDS) -> Centroids:
    """Learn from ``text`` and non-null ``lang`` of documents outside the held-out quarter.

    Document frequencies cover all of these documents; ``bound`` different texts
    of each language, chosen by their digests, are clustered, each language
    in a task of its own. What comes to the driver is ``k`` centroids per language.
    """
    known = documents.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("text", F.col("lang").alias("language"))
    frequencies, count = document_frequencies(known)
    idf = np.log((count + 1) / (frequencies + 1)) + 1
    sample = sample_texts(known, bound)

    def vectorised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = batch.column(1)
            for first, end, counts in count_grams(batch.column(0).to_pylist()):
                x = vectors(counts, idf)[counts.any(1)]
                names = language.slice(first, end - first).filter(pa.array(counts.any(1)))
                yield pa.RecordBatch.from_arrays([names, pa.array(list(x), pa.list_(pa.float32()))], ["language", "x"])

    def clustered(key, rows):
        import pandas as pd

        x = np.stack(rows["x"].to_numpy())
        x = x[np.lexsort(x.T[:8])]
        centres, floors = cluster(x, k)
        return pd.DataFrame({"language": key[0], "floor": floors, "centre": list(centres)})

    found = (
        sample.select("text", "language").mapInArrow(vectorised, "language string, x array<float>")
        .groupBy("language").applyInPandas(clustered, "language string, floor double, centre array<float>")
        .orderBy("language", "floor").collect()
    )
    return Centroids(
        idf,
        [row["language"] for row in found],
        np.array([row["centre"] for row in found], np.float32).reshape(-1, DIMENSIONS),
        np.array([row["floor"] for row in found]),
    )


def language(text: Column, model: Centroids) -> Column:
    """``struct<lang_pred string, score double, rejected boolean>`` of a text.

    ``score`` is the cosine to the nearest centroid; ``rejected`` marks texts
    farther from it than the texts it was fitted on. Null and texts without
    letters give ``und``, 0 and true.
    """

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def found(texts: pa.Array) -> pa.Array:
        names, scores, rejected = zip(*model.nearest(texts.to_pylist()), strict=True) if len(texts) else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([bool(r) for r in rejected], pa.bool_())],
            ["lang_pred", "score", "rejected"],
        )

    return found(text)
