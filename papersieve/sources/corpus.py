"""Documents: listing files, decoding pages, assembling texts, what is pending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions.text import file_name

# Fixed value: file names taken as documents, in any letter case.
DOCUMENT_GLOB = "*.[pP][dD][fF]"
HIDDEN_GLOB = "{[._]*,}.[pP][dD][fF]"
PAGE_TYPE = "path string, page_no int, page_text string"


def read_files(spark: SparkSession, folder: str, leave_hidden: bool = False) -> DataFrame:
    """Document files directly inside ``folder`` (Spark's ``binaryFile`` columns).

    An absent folder is an error, a folder without documents is not. Selecting
    ``path`` alone reads no file content. A subfolder is no document, whatever
    its name. Spark's readers can't read files whose names open with ``.`` or
    ``_``; if there are any, that is an error which gives their number, unless
    ``leave_hidden`` says to go on without them.
    """
    if not leave_hidden and (left := hidden_documents(spark, folder)):
        raise ValueError(f"{len(left)} documents of {folder} have hidden names and can't be read, such as {left[0]}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", DOCUMENT_GLOB)
    try:
        found = files.load(f"{folder.rstrip('/')}/{DOCUMENT_GLOB}")
        # the glob also opens a subfolder called like a document
        inside = F.regexp_count("path", F.lit("/")) > F.lit(_depth(spark, folder) + 1)
        return found.where(~inside)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return files.load(folder).where(F.lit(False))


def hidden_documents(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the documents directly inside ``folder`` that Spark's readers skip; only these come to the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{HIDDEN_GLOB}")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files = [s.getPath() for s in system.globStatus(path) or [] if s.isFile()]
    # Spark does read _name=value
    return sorted(f.toString() for f in files if not (f.getName().startswith("_") and "=" in f.getName()))


def _depth(spark: SparkSession, folder: str) -> int:
    """Slashes in the full path of ``folder``, as Spark spells the paths of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(path).toString().count("/")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``path, file_name`` of every document in a folder, those with hidden names as well."""
    paths = read_files(spark, folder, leave_hidden=True).select("path")
    hidden = spark.createDataFrame([(p,) for p in hidden_documents(spark, folder)], "path string")
    return paths.unionAll(hidden).select("path", file_name(F.col("path")).alias("file_name"))


def decode_pages(files: DataFrame, decoder: Callable[[bytes], list[str | None]]) -> DataFrame:
    """Page rows of files, with a decoder the caller brings for the file format.

    ``decoder`` turns the bytes of one file into its page texts in order. A file
    it fails on gets one page without text, which makes the document unreadable.
    Files reach it in batches of ``spark.sql.execution.arrow.maxRecordsPerBatch``
    rows; lower that setting where files are large.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    texts = list(decoder(bytes(content)))
                except Exception:  # noqa: BLE001 - one bad file must not end the job
                    texts = [None]
                rows += [(path, number, text) for number, text in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "page_text"])

    return files.select("path", "content").mapInPandas(decode, PAGE_TYPE)


def decode_text(files: DataFrame, decoder: Callable[[bytes], list[str | None]]) -> DataFrame:
    """``path, text`` of files in one pass, for when the pages are not wanted.

    All pages of a file are at hand where it is decoded, so that joining them
    there saves the shuffle of ``assemble_text``. The rules are the same.
    """
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append("".join(decoder(bytes(content))))
                except Exception:  # noqa: BLE001 - one bad file must not end the job
                    texts.append(None)
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(decode, "path string, text string")


def assemble_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, text``: page texts joined in page order, nothing between them.

    A page without text makes the whole document unreadable (NULL).
    """
    joined = F.expr("listagg(page_text, '') WITHIN GROUP (ORDER BY page_no)")
    readable = F.count_if(F.col("page_text").isNull()) == 0
    return pages.groupBy(key).agg(F.when(readable, joined).alias("text"))


def with_text(documents: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with their text; one that has no page at all has the empty text.

    Texts are never broadcast: the join reuses the partitions they were assembled in.
    """
    texts = assemble_text(pages, key).withColumn("_paged", F.lit(True))
    return (
        documents.join(texts.hint("merge"), key, "left")
        .withColumn("text", F.when(F.col("_paged"), F.col("text")).otherwise(F.lit("")))
        .drop("_paged")
    )


def pending_documents(documents: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that no earlier run has decided; the undecided ones come again.

    The manifest may hold a document many times. Its keys are made distinct, in
    part before the shuffle, so that a repeated one cannot fill a join partition.
    """
    decided = manifest.where(F.col("status").isin(*fv.DECIDED)).select(key).distinct()
    return documents.join(decided, key, "left_anti")
