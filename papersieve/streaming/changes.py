"""Tables that a stream corrects: each batch adds rows, and of a key the last one counts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def write_changes(
    changes: DataFrame, folder: str, checkpoint: str, *partitions: str, every: str | None = None
) -> StreamingQuery:
    """Write what changes in each batch of a stream to its own part of ``folder``.

    A batch that is repeated after a failure replaces its part, so its rows count
    once. ``folder`` and ``checkpoint`` belong together and in shared storage. Everything
    available is processed, then the query ends; with ``every``, such as ``10
    seconds``, it goes on until it is stopped.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partitions).parquet(f"{folder.rstrip('/')}/{BATCH}={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        changes.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def read_changes(spark: SparkSession, folder: str, columns: T.StructType) -> DataFrame:
    """All rows of ``folder`` with the number of their ``batch``; none where no batch was written."""
    shape = T.StructType([*columns.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(shape).parquet(folder).select(*[f"`{name}`" for name in shape.names])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], shape)


def newest(changes: DataFrame, *key: str) -> DataFrame:
    """The rows of the last batch that holds their ``key``, without the number of the batch.

    Only keys and numbers are aggregated; whole rows are joined to them.
    """
    last = changes.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max(BATCH).alias("__last"))
    same = F.col(BATCH) == F.col("__last")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return changes.join(last, same).drop(BATCH, "__last", *[f"__{k}" for k in key])
