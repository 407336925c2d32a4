"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, codes, parts, spans
from .common import labelled_sample

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
TERMS = 512
FACTORS = 8
SAMPLE = 20_000
"""Labelled documents that a model is fitted on, at most (about)."""


def term_blocks(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For consecutive ranges of whole texts: first, end, hashed terms, and the text of each term.

    Terms are the words and the beginnings of longer words, as often as they occur.
    """
    for first, end in spans(texts):
        ends = np.cumsum([len(t) + 1 for t in texts[first:end]])
        pieces = parts(texts[first]) if end - first == 1 else ["\n".join(texts[first:end])]
        found, owners = [], []
        for piece in pieces:
            words = Words(codes(piece))
            rows = np.searchsorted(ends, words.starts, "right") if end - first > 1 else words.starts * 0
            found.append(words.hashes())
            owners.append(rows)
            for n in PREFIXES:
                longer = words.lengths > n
                found.append(words.prefixes(n)[longer])
                owners.append(rows[longer])
        yield first, end, (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.int64)
        for first, _, found, owners in term_blocks(batch.column(0).to_pylist()):
            pairs = np.unique(owners * BUCKETS + found)
            np.add.at(counts, (labels[first + pairs // BUCKETS], pairs % BUCKETS), 1)
    seen = np.flatnonzero(counts.sum(0))
    for at in np.split(seen, range(100_000, len(seen), 100_000)):
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])],
            ["term", "negative", "positive"],
        )


def choose_terms(sample: DataFrame, count: int = TERMS) -> np.ndarray:
    """The terms that tell the labels of ``sample`` (``text``, ``label``) apart best, by chi-square."""
    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    n0, n1 = max(sizes.get(0, 0), 1), max(sizes.get(1, 0), 1)
    a, b = F.col("positive").cast("double"), F.col("negative").cast("double")
    expected = (a + b) * n1 / (n0 + n1)
    best = (
        sample.select("text", "label")
        .mapInArrow(_counts, "term bigint, negative bigint, positive bigint")
        .groupBy("term")
        .agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))
        .where(a + b >= 5)
        .select("term", (F.pow(a - expected, 2) / expected / (1 - (a + b) / (n0 + n1 + 1))).alias("chi"))
        .orderBy(F.desc("chi"), "term")
        .limit(count)
        .collect()
    )
    return np.sort(np.array([row["term"] for row in best], np.int64))


@dataclasses.dataclass
class FactorizationMachine:
    """``bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j`` over terms that a text holds or not."""

    vocabulary: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def present(self, texts: list[str]) -> list[np.ndarray]:
        """For each whole text, the places in the vocabulary of the terms that it holds."""
        size = len(self.vocabulary)
        places = np.full(BUCKETS, -1, np.int64)
        places[self.vocabulary] = np.arange(size)
        out: list[np.ndarray] = []
        for first, end, found, owners in term_blocks(texts):
            at = places[found]
            pairs = np.unique(owners[at >= 0] * size + at[at >= 0])
            cuts = np.searchsorted(pairs, np.arange(1, end - first) * size)
            out += [p % size for p in np.split(pairs, cuts)]
        return out

    def margin(self, places: np.ndarray) -> float:
        v = self.factors[places]
        pairs = 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(self.bias + self.weights[places].sum() + pairs)

    def scores(self, texts: list[str | None]) -> list[float]:
        margins = np.array([self.margin(p) for p in self.present([t or "" for t in texts])])
        return (1 / (1 + np.exp(-np.clip(margins, -30, 30)))).tolist()


def fit_machine(
    vocabulary: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 60, seed: int = 7
) -> FactorizationMachine:
    """Minimise logistic loss by mini-batches with step sizes adapted to each weight.

    ``x`` holds one row of 0 and 1 per document, ``y`` its labels. Without
    both labels there is nothing to tell apart: the machine then returns the
    share of the one label, smoothed.
    """
    random = np.random.default_rng(seed)
    n, f = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    bias, w = np.log(rate / (1 - rate)), np.zeros(f)
    v = random.normal(0, 0.02, (f, FACTORS))
    if n == 0 or y.min() == y.max():
        return FactorizationMachine(vocabulary, float(bias), w, v * 0)
    seen = [np.full_like(a, 1e-6) for a in (np.zeros(1), w, v)]
    for _ in range(rounds):
        order = random.permutation(n)
        for at in np.array_split(order, max(1, n // 512)):
            xb, yb = x[at].astype(np.float64), y[at]
            xv = xb @ v
            z = bias + xb @ w + 0.5 * (xv**2 - xb @ v**2).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(at)
            slopes = (
                np.array([g.sum()]),
                xb.T @ g + 1e-5 * w,
                xb.T @ (g[:, None] * xv) - (xb.T @ g)[:, None] * v + 1e-5 * v,
            )
            for total, slope in zip(seen, slopes, strict=True):
                total += slope**2
            bias -= 0.1 * slopes[0][0] / np.sqrt(seen[0][0])
            w -= 0.1 * slopes[1] / np.sqrt(seen[1])
            v -= 0.03 * slopes[2] / np.sqrt(seen[2])
    return FactorizationMachine(vocabulary, float(bias), w, v)


def train(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> FactorizationMachine:
    """Learn ``labels.toxic`` from texts outside the held-out quarter.

    ``documents`` (``doc_id``, ``text``), ``labels`` (``doc_id``, ``toxic``).
    About ``bound`` labelled documents are used, whole; their terms are counted
    on the executors, and only the chosen ``TERMS`` come to the driver.
    """
    sample = labelled_sample(documents, labels, "toxic", bound)
    vocabulary = choose_terms(sample)
    blank = FactorizationMachine(vocabulary, 0.0, np.zeros(len(vocabulary)), np.zeros((len(vocabulary), 1)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p.tolist() for p in blank.present(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["places", "label"]
            )

    rows = sample.select("text", "label").mapInArrow(places, "places array<int>, label int")
    rows = rows.orderBy("places", "label").toArrow()  # in one order, whatever the partitions
    found, y = rows["places"].to_pylist(), np.array(rows["label"].to_pylist(), np.float64)
    x = np.zeros((len(y), len(vocabulary)), np.uint8)
    for i, at in enumerate(found):
        x[i, at] = 1
    return fit_machine(vocabulary, x, y)


def toxicity(text: Column, model: FactorizationMachine) -> Column:
    """Probability that a text is toxic, from 0 to 1; null and empty texts get that of no terms."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return scored(text)
