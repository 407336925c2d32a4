"""Shards by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 40
RUNS = 256
"""Separately numbered runs in each shard, so that no task numbers a whole shard."""


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: the last jump that stays below ``shards``."""
    keys = keys.astype(np.uint64)
    place = np.zeros(len(keys), np.int64)
    jumping = np.arange(len(keys))
    while len(jumping):
        keys[jumping] = keys[jumping] * np.uint64(2862933555777941757) + np.uint64(1)
        step = ((keys[jumping] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        target = np.floor((place[jumping] + 1) * (float(1 << 31) / step)).astype(np.int64)
        inside = target < shards
        jumping, target = jumping[inside], target[inside]
        place[jumping] = target
    return place


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a stable integer key; null counts as key 0.

    With one shard more, a key stays or moves into the new shard.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.arrow_udf("int")
    def placed(keys: pa.Array) -> pa.Array:
        values = np.array(keys.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        return pa.array(jump(values.view(np.uint64), shards).astype(np.int32))

    return placed(key.cast("bigint"))


def assign(documents: DataFrame, shards: int = SHARDS, runs: int = RUNS) -> DataFrame:
    """Shard and slot of every document (``doc_id``, ``text``); texts are read, never moved.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text and 16), ``text_crc32``
    (null text: that of no bytes), ``shard``, ``grown_shard`` (with one shard
    more) and ``slot``, gapless from 0 in each shard. Slots follow the hash of
    ``doc_id``, then ``doc_id`` and text; repeated rows get slots of their own. A
    null ``doc_id`` is key 0. Each shard is numbered in ``runs`` runs side by side.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), shards).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(runs)).cast("int").alias("run"),
    )
    rows = stored(rows)
    sizes = rows.groupBy("shard", "run").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "shard", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )  # shards x runs rows, however many documents
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("number", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard",
        (F.col("start") + F.col("number")).cast("bigint").alias("slot"),
    )
