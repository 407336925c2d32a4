"""Benchmark passages in training texts: hashed item windows are broadcast, hits checked word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, stored

WINDOW = 10
ANCHOR = 3
"""Words of a window that are looked up at every place of a text; the whole window is compared after a hit."""
BROADCAST_ROWS = 1_000_000
"""Item windows that are broadcast at once (some 150 bytes each); more are taken in turns."""
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
"""What separates lower-cased words."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a whole text, with A-Z (and nothing else) in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN, -1), "")


def _anchor(array: Column, place: Column, length: int) -> Column:
    """Hash of ``length`` words from the 0-based ``place``."""
    return F.xxhash64(*(F.get(array, place + i) for i in range(length)), F.lit(length))


def _window(array: Column, place: Column, length: Column) -> Column:
    return F.array_join(F.slice(array, place + 1, length), " ")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows of all items: ``item_id``, ``window`` (its words), ``length``, ``anchor_length``, ``anchor``.

    An item of fewer than ``size`` words, but not none, is one window.
    """
    items = benchmark.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")
    )
    placed = items.where(F.size("w") > 0).select(
        "item_id", "w", F.least(F.size("w"), F.lit(size)).alias("length"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("place"),
    )
    hashed = F.coalesce(
        *(F.when(F.col("length") == n, _anchor(F.col("w"), F.col("place"), n)) for n in range(1, ANCHOR)),
        _anchor(F.col("w"), F.col("place"), ANCHOR),
    )
    return placed.select(
        "item_id", _window(F.col("w"), F.col("place"), F.col("length")).alias("window"), "length",
        F.least("length", F.lit(ANCHOR)).alias("anchor_length"), hashed.alias("anchor"),
    ).distinct()


def scan(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """What of ``benchmark`` (``item_id``, ``text``) occurs in ``documents`` (``doc_id``, ``text``).

    Returns a row per document row: ``doc_id``, ``text_digest``, ``n_words``,
    ``hit_words`` (sorted 0-based places of words inside any occurrence of a
    window) and ``items`` (sorted distinct ids, as strings). Null texts have no
    words; items without words, and null items, never occur; repeated
    documents get a row each.

    Windows are broadcast, at most ``BROADCAST_ROWS`` at once: one scan of the
    texts for each such set. A text gives one row for itself and one for each
    place where a window begins; only those rows are shuffled, never a text.
    """
    known = stored(windows(benchmark, size))
    turns = max(1, -(-known.count() // BROADCAST_ROWS))
    lengths = [r[0] for r in known.select("anchor_length").distinct().orderBy("anchor_length").collect()]
    texts = documents.select("doc_id", digest(F.col("text")).alias("text_digest"), words(F.col("text")).alias("w"))
    # place -1 stands for the text itself
    places = texts.select("*", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("place"))
    if len(lengths) > 1:
        anchors = F.array(*(_anchor(F.col("w"), F.col("place"), n) for n in lengths))
        places = places.select("*", F.posexplode(anchors).alias("which", "begun"))
        itself = (F.col("place") < 0) & (F.col("which") == 0)
    else:
        places = places.withColumn("begun", _anchor(F.col("w"), F.col("place"), lengths[0] if lengths else ANCHOR))
        itself = F.col("place") < 0
    rows = None
    for turn in range(turns):
        mine = known.where(F.pmod("anchor", F.lit(turns)) == turn)
        hit = (
            (F.col("place") >= 0) & (F.col("begun") == F.col("anchor"))
            & (_window(F.col("w"), F.greatest("place", F.lit(0)), F.col("length")) == F.col("window"))
        )
        found = places.join(F.broadcast(mine), hit, "left").where(F.col("item_id").isNotNull() | (F.lit(turn == 0) & itself))
        found = found.select(
            "doc_id", "text_digest", "place", "length", "item_id",
            F.when(F.col("item_id").isNull(), F.size("w").cast("bigint")).alias("n_words"),
        )
        rows = found if rows is None else rows.unionAll(found)
    whole = rows.groupBy("doc_id", "text_digest").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").cast("int").alias("copies"),
        F.collect_set(F.when(F.col("place") >= 0, F.struct("place", "length"))).alias("hits"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    inside = F.flatten(F.transform("hits", lambda h: F.sequence(h["place"], h["place"] + h["length"] - 1)))
    return whole.select(
        "doc_id", "text_digest", "n_words", F.array_sort(F.array_distinct(inside)).alias("hit_words"), "items",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def contaminated(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Identities (``doc_id``, ``text_digest``) and ``hit_words`` of the documents that hold item windows; distinct."""
    return scan(documents, benchmark, size).where(F.size("hit_words") > 0).select("doc_id", "text_digest", "hit_words").distinct()


def remove_documents(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` without those in which a benchmark window occurs; all columns are kept."""
    bad = stored(contaminated(documents, benchmark, size))
    mine = documents.withColumn("__digest", digest(F.col("text")))
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__bad")).distinct()
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return mine.join(
        bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__bad")), "left_anti"
    ).drop("__digest")


def remove_spans(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``documents`` with the words of benchmark windows cut out of the text, and ``n_chars`` counted anew if present.

    A cut text keeps what stands before each remaining word; all else stays as it is.
    """
    bad = stored(contaminated(documents, benchmark, size)).select(
        F.col("doc_id").alias("__id"), F.col("text_digest").alias("__bad"), F.col("hit_words").alias("__hits")
    )
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    mine = documents.withColumn("__digest", digest(F.col("text"))).join(
        bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__bad")), "left"
    )
    gaps, tokens = F.split("text", word, -1), F.regexp_extract_all(F.col("text"), F.lit(f"({word})"))
    pairs = F.transform(F.arrays_zip(gaps.alias("gap"), tokens.alias("word")), lambda p, i: F.struct(
        F.coalesce(p["gap"], F.lit("")).alias("gap"), F.coalesce(p["word"], F.lit("")).alias("word"), i.alias("i")))
    left = F.filter(pairs, lambda p: ~F.coalesce(F.array_contains("__hits", p["i"]), F.lit(False)))
    cut = F.array_join(F.transform(left, lambda p: F.concat(p["gap"], p["word"])), "")
    text = F.when(F.col("__hits").isNull(), F.col("text")).otherwise(cut)
    columns = {"text": text} | ({"n_chars": F.length(text).cast("bigint")} if "n_chars" in documents.columns else {})
    return mine.withColumns(columns).drop("__digest", "__id", "__bad", "__hits")
