"""Token totals kept up to date by signed deltas, in batches that can be committed again."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .tokens import default_path, tokenizer

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["documents", "tokens", "bytes"]


def count_tokens(text: Column, path: str | None = None) -> Column:
    """How many ids the tokenizer file ``path`` gives a whole text; null counts as empty."""
    file = path or default_path()

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        ids = tokenizer(file).ids
        return pa.array([len(ids(t or "")) // 4 for t in texts.to_pylist()], pa.int64())

    return counted(text)


def deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Signed changes of totals: what ``after`` adds and ``before`` takes away.

    Both hold ``source``, ``lang``, ``tokenizer``, ``tokens`` and ``bytes`` per
    document. An insert has no ``before``, a delete no ``after``, a revised
    document has its old row in one and its new row in the other.
    """
    signed = [
        df.select(*KEYS, F.lit(sign).alias("documents"), (F.col("tokens") * sign).alias("tokens"), (F.col("bytes") * sign).alias("bytes"))
        for df, sign in ((before, -1), (after, 1))
        if df is not None
    ]
    if not signed:
        raise ValueError("nothing changed")
    return signed[0] if len(signed) == 1 else signed[0].unionAll(signed[1])


class Rollup:
    """Additive totals in a folder that all executors share.

    Each batch is a table of its own, summed before it is written. A batch
    counts once its name is in the log of commits, which is written last: a
    batch that broke off is written anew, and one that was committed is never
    added again. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self._spark.read.schema(schema).parquet(f"{self._folder}/{path}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self._spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        """Names of the batches that count."""
        return self._read("commits", "batch string").distinct()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (see ``deltas``); False, and nothing read, if ``batch`` was committed before."""
        if not batch or not all(c.isalnum() or c in "-." for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed().where(F.col("batch") == batch).limit(1).count():
            return False
        summed = changes.groupBy(*KEYS).agg(*(F.sum(t).cast("bigint").alias(t) for t in TOTALS))
        summed.write.mode("overwrite").parquet(f"{self._folder}/batches/batch={batch}")
        self._spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(
            f"{self._folder}/commits"
        )
        return True

    def batches(self) -> DataFrame:
        """Summed changes of each committed batch; those that broke off are left out."""
        schema = "source string, lang string, tokenizer string, documents bigint, tokens bigint, bytes bigint, batch string"
        return self._read("batches", schema).join(self.committed(), "batch", "left_semi")

    def totals(self) -> DataFrame:
        """Totals per source, language and tokenizer version; those that have come to nothing are left out."""
        summed = self.batches().groupBy(*KEYS).agg(*(F.sum(t).alias(t) for t in TOTALS))
        return summed.where(" OR ".join(f"{t} <> 0" for t in TOTALS))
