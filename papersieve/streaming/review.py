"""Reviewing replies as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papersieve.plans.review import review_replies
from papersieve.schema import ReviewSchema
from papersieve.streaming.changes import newest, read_changes, write_changes

REPLY = "doc_id bigint, file_name string, has_text boolean, response string"


def greatest_replies(replies: DataFrame) -> DataFrame:
    """One row for each document: its greatest reply in the order of strings, as ``attach_responses`` keeps it.

    A document without text was never sent, so that no reply to it counts.

    On a stream the reply is state, and a document comes again whenever it may have changed.
    """
    kept = F.max(F.struct("response", "file_name", "has_text"))
    return replies.groupBy("doc_id").agg(kept.alias("kept")).select(
        "doc_id", "kept.file_name", "kept.has_text", F.when(F.col("kept.has_text"), F.col("kept.response")).alias("response")
    )


def start_review(
    replies: DataFrame, schema: ReviewSchema, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the decisions for a stream of ``doc_id, file_name, has_text, response`` to ``folder``.

    A reply may come any number of times, and another one for the same document
    later: the state of the query holds the reply of each document that counts, and a
    decision that changes is written again. ``read_review`` gives the last decision for each
    document, which is what ``review`` makes of all replies at once. Everything available is
    processed, then the query ends; started again with the same ``checkpoint`` it goes on with what is
    new. Where documents are many, set ``spark.sql.streaming.stateStore.providerClass``
    to the RocksDB provider, which keeps state on disk.
    """
    return write_changes(review_replies(greatest_replies(replies), schema), folder, checkpoint, "status", every=every)


def read_review(spark: SparkSession, folder: str, schema: ReviewSchema) -> DataFrame:
    """The last decision for each document that ``start_review`` has written."""
    columns = review_replies(spark.createDataFrame([], REPLY), schema).schema
    return newest(read_changes(spark, folder, columns), "doc_id")
