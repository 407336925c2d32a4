"""What the operators of this folder share: stored tables, samples, held-out rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.sources.storage import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder of the cluster, and read again.

    Cuts the lineage: what reads the table survives lost executors, and every
    reader sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no model may learn from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def digest(text: Column) -> Column:
    """Identity of a text; null for null."""
    return F.md5(text.cast("binary"))


def bounded_sample(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """About ``bound`` of ``rows``, chosen by the hash of ``key``; all if there are no more."""
    count = rows.count()
    if count <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int((1 << 30) * bound / count))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Texts and labels (``text``, ``label``) of about ``bound`` documents outside the held-out quarter.

    Only labels that are 0 or 1 count; a document labelled twice counts once,
    with its larger label. The sampled labels are broadcast, so ``bound`` is
    also the proven bound of the broadcast. The result is stored.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = bounded_sample(known, bound, "doc_id")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"))
