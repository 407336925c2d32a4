"""Near-duplicates by DartMinHash signatures, joined in bands and checked on the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import mix, text_slices, word_blocks
from .common import digest, stored
from .components import components, merged

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
"""At similarity 0.8 a pair misses all 20 bands of 5 once in 2,800 times, at 0.85 once in 37,000."""
BROADCAST_IDS = 1_000_000
"""Ids that are broadcast to find their texts; with more, both sides are shuffled."""
MORE_HUBS = 8
"""By this factor more hubs are met in each further round."""
SHARES = 16
"""Tasks that the comparisons with one hub are spread over."""

_U = np.uint64


def shingles(hashes: np.ndarray, rows: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``words`` words in a row, and the text of each; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes, rows
    total = np.zeros(max(n - words + 1, 0), _U)
    for i in range(words if n >= words else 0):
        total = mix(total ^ (hashes[i : n - words + 1 + i] + _U(i)))
    whole = rows[: len(total)] == rows[n - len(total) :] if len(total) else np.zeros(0, bool)
    found, owners = total[whole], rows[: len(total)][whole]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    for start, size in zip(starts[sizes < words], sizes[sizes < words], strict=True):
        one = mix(np.array([size], _U))
        for h in hashes[start : start + size]:
            one = mix(one ^ h)
        found, owners = np.append(found, one), np.append(owners, rows[start])
    return found, owners


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 1) / (1 << 53)


def signatures(
    elements: np.ndarray, owners: np.ndarray, texts: int, k: int, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """DartMinHash: for each text the earliest dart of each of ``k`` coordinates, and which texts have any.

    Darts fall on the plane of weight and time of each element, one per unit of
    area, each on a random coordinate; a text sees those below its element's
    weight. Weights are laid out in regions [0, 1), [1, 2), [2, 4), ... whose darts
    depend on the element and region only. A text looks so far in time that
    about ``k (ln k + 3)`` darts are expected, and twice as far again while a
    coordinate is empty; so the work for a text hardly depends on its length.
    Two texts agree on a coordinate with the probability of their weighted
    Jaccard similarity.
    """
    if weights is not None:
        reach = np.maximum(np.ceil(np.log2(np.maximum(weights, 1e-300))), 0).astype(np.int64) + 1
        source = np.repeat(np.arange(len(elements)), reach)
        region = np.arange(len(source)) - np.repeat(np.cumsum(reach) - reach, reach)
        low = np.where(region == 0, 0.0, 2.0 ** (region - 1))
        rate = np.where(region == 0, 1.0, low)
        elements, owners = mix(elements[source] ^ mix(region.astype(_U))), owners[source]
        limit = weights[source]
        mass = np.bincount(owners, np.minimum(limit - low, rate), texts)
    else:
        low = limit = None
        rate = np.ones(len(elements))
        mass = np.bincount(owners, minlength=texts).astype(float)
    best = np.full(texts * k, np.inf)
    filled = mass > 0
    horizon = k * (np.log(k) + 3) / np.maximum(mass, 1e-300)
    waiting = filled.copy()
    while waiting.any():
        at = np.flatnonzero(waiting[owners])
        time, draw = np.zeros(len(at)), 0
        while len(at):
            dart = mix(elements[at] + _U(0xD1B54A32D192ED03 * (draw + 1) % 2**64))
            time = time - np.log(_uniform(dart)) / rate[at]
            draw += 1
            soon = time <= horizon[owners[at]]
            at, time, dart = at[soon], time[soon], dart[soon]
            seen = mix(dart)
            hit = slice(None)
            if limit is not None:
                hit = low[at] + _uniform(mix(seen ^ _U(5))) * rate[at] < limit[at]
            place = owners[at][hit] * k + (seen[hit] % _U(k)).astype(np.int64)
            np.minimum.at(best, place, time[hit])
        waiting &= np.isinf(best.reshape(texts, k)).any(1)
        horizon[waiting] *= 2
    return best.reshape(texts, k).view(_U), filled


def bands(marks: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each signature; keys of different bands differ."""
    keys = np.tile(mix(np.arange(count, dtype=_U)), (len(marks), 1))
    for i in range(rows):
        keys = mix(keys ^ marks[:, i : count * rows : rows])
    return keys.view(np.int64)


def text_bands(texts: list[str], weighted: bool = False) -> list[np.ndarray | None]:
    """Band keys of each whole text; None for texts without words."""
    out: list[np.ndarray | None] = []
    for first, end, hashes, rows in word_blocks(texts):
        found, owners = shingles(hashes, rows)
        weights = None
        if weighted:
            order = np.lexsort((found, owners))
            found, owners = found[order], owners[order]
            new = np.concatenate(([True], (found[1:] != found[:-1]) | (owners[1:] != owners[:-1])))[: len(found)]
            at = np.flatnonzero(new)
            weights = np.diff(np.append(at, len(found))).astype(float)
            found, owners = found[at], owners[at]
        marks, filled = signatures(found, owners, end - first, BANDS * ROWS, weights)
        out += [key if some else None for key, some in zip(bands(marks), filled, strict=True)]
    return out


def weighted_shingles(text: str, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a whole text, sorted, and their weights: 1, or how often each occurs."""
    found = np.concatenate([shingles(h, r)[0] for *_, h, r in word_blocks([text])])
    distinct, counts = np.unique(found, return_counts=True)
    return distinct, counts if weighted else np.ones(len(counts), np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two results of ``weighted_shingles``."""
    (x, n), (y, m) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common, total = np.minimum(n[i], m[j]).sum(), n.sum() + m.sum()
    return float(common / (total - common)) if total else 0.0


def similarity(a: str, b: str, weighted: bool = False) -> float:
    """Jaccard similarity of the shingles of two whole texts; weighted: each as often as it occurs."""
    return overlap(weighted_shingles(a, weighted), weighted_shingles(b, weighted))


def _verified(pairs: DataFrame, texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """The ``pairs`` (``a`` and its hub ``b``) of digests whose texts are similar; stored.

    A hub's text goes once to each of its ``SHARES``, before the texts that are compared with it, and is cut into shingles
    once there.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, shingled = None, None
        for batch in batches:
            near: list[tuple[str, str]] = []
            for i in range(batch.num_rows):
                a, b, text = (batch.column(c)[i].as_py() for c in range(3))
                if a is None:
                    hub, shingled = b, weighted_shingles(text, weighted)
                elif b == hub and overlap(weighted_shingles(text, weighted), shingled) >= least:
                    near.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in near], pa.string()) for k in (0, 1)], ["a", "b"]
            )

    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(SHARES)).cast("int").alias("share"))
    members = dealt.join(texts.select(F.col("text_digest").alias("a"), "text"), "a")
    hubs = dealt.select("b", "share").distinct().join(texts.select(F.col("text_digest").alias("b"), "text"), "b")
    both = members.unionByName(hubs.withColumn("a", F.lit(None).cast("string")))
    ordered = both.repartition("b", "share").sortWithinPartitions("b", "share", F.col("a").asc_nulls_first())
    return stored(ordered.select("a", "b", "text").mapInArrow(check, "a string, b string"))


def _texts_of(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text for each digest in ``pairs``, stored."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("text_digest")).distinct()
    wanted = stored(wanted)
    small = wanted.count() <= BROADCAST_IDS
    found = documents.select(digest(F.col("text")).alias("text_digest"), "text").join(
        F.broadcast(wanted) if small else wanted, "text_digest", "left_semi"
    )
    return stored(found.groupBy("text_digest").agg(F.first("text").alias("text")))


def _shingle_rows(texts: DataFrame, weighted: bool) -> DataFrame:
    """``text_digest``, ``shingle``, ``weight``, stored."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, text = (c[i].as_py() for c in batch.columns)
                keys, weights = weighted_shingles(text, weighted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(weights)],
                    ["text_digest", "shingle", "weight"],
                )

    return stored(
        texts.select("text_digest", "text").mapInArrow(listed, "text_digest string, shingle bigint, weight bigint")
    )


def _mixed(placed: DataFrame, bucket: str) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    mixed = placed.groupBy(bucket).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(mixed.where("low < high").select(bucket), bucket)


def _rarest(placed: DataFrame, texts: DataFrame, least: float, weighted: bool) -> DataFrame:
    """``shingle``, ``text_digest``, ``size``, ``before``: by which texts of mixed buckets can be similar at all; stored.

    Similar texts have ``least / (1 + least)`` of their joint weight in common.
    So of all shingles of a text, rarest first, one must be shared among the
    first few: those that outweigh what it may lack of the smallest text in its
    buckets. Texts that have only a widespread passage in common share none. ``before`` is the weight of the
    shingles that come first; those of one text alone lead, and are only added up.
    """
    apart = stored(_mixed(placed, "band").select("band", "text_digest"))
    rows = _shingle_rows(texts.join(apart.select("text_digest").distinct(), "text_digest", "left_semi"), weighted)
    measured = stored(rows.groupBy("text_digest").agg(F.sum("weight").alias("size")))
    inside = apart.join(measured, "text_digest")
    smallest = inside.groupBy("band").agg(F.min("size").alias("smallest"))
    partner = inside.join(smallest, "band").groupBy("text_digest").agg(F.min("smallest").alias("smallest"))
    lack = F.col("size") - (F.col("size") + F.col("smallest")) * (least / (1 + least)) + 1e-6

    texts_with = rows.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    whole = Window.partitionBy("text_digest")
    rare_first = whole.orderBy("texts", "shingle")
    shared = F.sum("weight").over(rare_first) - F.col("weight") - F.sum("weight").over(whole)
    return stored(
        rows.join(texts_with, "shingle").withColumn("shared", shared)
        .join(measured.join(partner, "text_digest"), "text_digest")
        .withColumn("before", F.col("size") + F.col("shared"))
        .where(F.col("before") <= lack)
        .select("shingle", "text_digest", "size", "before")
    )


def _with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of their ``text_digest``; a text that is in none is its own."""
    there = rows.join(found.withColumnRenamed("node", "text_digest"), "text_digest", "left")
    return there.withColumn("component", F.coalesce("component", "text_digest"))


def _rejoined(
    found: DataFrame, rarest: DataFrame, done: DataFrame, texts: DataFrame, least: float, weighted: bool
) -> DataFrame:
    """The components ``found``, joined further by what texts share of their rarest shingles.

    In each round every text is compared with the hubs of its shingles that are in
    another component, if the weights allow it; hubs are the most popular
    texts. They have then met all others and leave, and so do shingles that are left with one component.
    Their number grows by ``MORE_HUBS`` each round, so a few rounds compare all that must be compared; a group of
    many similar texts falls to its first hubs, at about one comparison each.
    """
    most = F.col("size") - F.col("before"), F.col("hub_size") - F.col("hub_before")
    needed = (F.col("size") + F.col("hub_size")) * (least / (1 + least)) - 1e-6
    met = rarest.groupBy("shingle").agg(F.count("*").alias("n"))
    popular = rarest.join(met, "shingle").groupBy("text_digest").agg(F.sum("n").alias("popularity"))
    rows, hubs = rarest.join(popular, "text_digest"), 1
    while True:
        rows = stored(_mixed(_with_components(rows, found), "shingle"))
        if rows.isEmpty():
            return found
        by_fame = Window.partitionBy("shingle").orderBy(F.desc("popularity"), "text_digest")
        chosen = stored(rows.withColumn("place", F.row_number().over(by_fame)).where(F.col("place") <= hubs))
        hub = chosen.select(
            "shingle", F.col("text_digest").alias("hub"), F.col("component").alias("hub_component"),
            F.col("size").alias("hub_size"), F.col("before").alias("hub_before"), "place",
        )
        meeting = rows.join(hub, "shingle").where(
            (F.col("component") != F.col("hub_component")) & (F.least(*most) >= needed)
        )
        # two hubs meet once
        low, high = F.least("text_digest", "hub").alias("low"), F.greatest("text_digest", "hub").alias("high")
        new = meeting.groupBy(low, high).agg(F.max("hub").alias("b")).join(done, ["low", "high"], "left_anti")
        new = stored(new.withColumn("a", F.when(F.col("b") == F.col("low"), F.col("high")).otherwise(F.col("low"))))
        if not new.isEmpty():
            links = _verified(new.select("a", "b"), texts, least, weighted)
            if not links.isEmpty():
                found = stored(merged(found, links))
            done = done.unionAll(new.select("low", "high"))
        rows = rows.join(chosen.select("shingle", "text_digest"), ["shingle", "text_digest"], "left_anti").drop("component")
        hubs *= MORE_HUBS


def near_duplicates(
    documents: DataFrame, least: float = SIMILARITY, weighted: bool = False
) -> DataFrame:
    """Classes of ``documents`` (``doc_id``, ``text``): one row per document with its class.

    Returns ``doc_id``, ``text_digest`` and ``class_digest``. Texts are linked if the
    similarity of their shingles of five words (words as in ``arrays.Words``) is ``least`` or more; a class is
    all that is linked directly or in turn. Equal texts are one node, so
    copies cost nothing. A text of fewer than five words is one shingle; one
    without any word is linked to equal texts only. A null text is in no
    class (null digests). Repeated rows each get their row.

    Each band bucket links its members to one hub first: the member that meets
    most texts over all its buckets, so the original rather than one of its
    altered copies. What is still apart within a bucket after that is compared
    with further hubs, if the rarest shingles of two texts allow it. So every
    pair that shares a bucket is compared, or cannot be similar, or is in one
    class already; a group of many similar texts costs about one comparison each.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in text_slices(batch.column(1)):
                keys = text_bands(texts, weighted)
                rows = [None if k is None else k.tolist() for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(rows, pa.list_(pa.int64()))],
                    ["text_digest", "bands"],
                )
                first += len(texts)

    ids = documents.select("doc_id", digest(F.col("text")).alias("text_digest"))
    marks = (
        documents.where("text IS NOT NULL")
        .select(digest(F.col("text")).alias("text_digest"), "text")
        .mapInArrow(signed, "text_digest string, bands array<bigint>")
        .groupBy("text_digest")
        .agg(F.first("bands").alias("bands"))
        .select("text_digest", F.explode("bands").alias("band"))
    )
    marks = stored(marks)
    shared = marks.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(marks.join(shared, "band"))
    popular = members.groupBy("text_digest").agg(F.sum("n").alias("popularity"))
    members = stored(members.drop("n").join(popular, "text_digest"))
    hubs = members.groupBy("band").agg(F.max(F.struct("popularity", "text_digest"))["text_digest"].alias("hub"))
    members = stored(members.join(hubs, "band").select("band", "text_digest", "hub"))
    pairs = stored(members.where("text_digest <> hub").select(F.col("text_digest").alias("a"), F.col("hub").alias("b")).distinct())
    texts = _texts_of(documents, pairs)
    links = _verified(pairs, texts, least, weighted)
    found = stored(components(links))

    rarest = _rarest(_with_components(members.select("band", "text_digest"), found), texts, least, weighted)
    done = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    found = _rejoined(found, rarest, done, texts, least, weighted)
    return ids.join(found, ids["text_digest"] == found["node"], "left").select(
        "doc_id", "text_digest", F.coalesce("component", "text_digest").alias("class_digest")
    )


def keep_one(documents: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """``documents`` with one document of each class: the least ``doc_id``, nulls last.

    All columns are kept as they are. Documents with null text all stay. Rows
    that repeat both ``doc_id`` and text count as one document.
    """
    classes = stored(near_duplicates(documents, least, weighted))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_digest").alias("d"))
    best = classes.where("text_digest IS NOT NULL").groupBy("class_digest").agg(F.min(order).alias("best"))
    copies = classes.groupBy("doc_id", "text_digest").agg(F.count("*").alias("n"))
    winners = best.select("best.i", "best.d").join(
        copies.withColumnsRenamed({"doc_id": "i2", "text_digest": "d2"}),
        F.col("i").eqNullSafe(F.col("i2")) & (F.col("d") == F.col("d2")),
    )
    winners = stored(winners.select("i", "d", "n"))
    marked = documents.withColumn("__digest", digest(F.col("text")))
    kept = marked.join(
        winners.withColumnsRenamed({"i": "__i", "d": "__d", "n": "__n"}),
        F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")),
    )
    columns = [F.col(f"`{c}`") for c in documents.columns]
    out = kept.where("__n = 1").select(*columns)
    if winners.where("n > 1").limit(1).count():
        out = out.unionByName(kept.where("__n > 1").dropDuplicates(["doc_id", "__digest"]).select(*columns))
    return out.unionByName(documents.where("text IS NULL"))
