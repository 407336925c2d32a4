"""Report tables of a triaged review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions.text import file_stem, preview
from papersieve.operators.parsing import extraction_wide, quality_wide
from papersieve.schema import ReviewSchema


def quality_report(triaged: DataFrame, schema: ReviewSchema, *keys: str) -> DataFrame:
    """A row for every reply that was parsed, accepted or not."""
    parsed = triaged.where(F.col("status").isin(*fv.DECIDED))
    wide = quality_wide(parsed, schema, *keys, F.col("title").alias(fv.TITLE))
    return wide.select(*keys, *[f"`{name}`" for name in schema.qa_header()])


def extraction_report(triaged: DataFrame, schema: ReviewSchema, *keys: str) -> DataFrame:
    """A row for every accepted document with at least one field.

    Where the reply has a title field, it shows the resolved title, as the
    quality report does.
    """
    accepted = triaged.where((F.col("status") == fv.ANALYSED) & (F.size("de_items") > 0))
    shown = F.when(F.col("has_title"), F.col("title")).otherwise("")
    wide = extraction_wide(accepted, schema, *keys, shown.alias("_shown_title"))
    return wide.select(
        *keys,
        *[
            F.col("_shown_title").alias(name)
            if name == fv.TITLE else F.col(f"`{name}`")
            for name in schema.de_header()
        ],
    )


def manifest(triaged: DataFrame) -> DataFrame:
    """``doc_id, file_name, status, reason, excluded_by``, a row for each document."""
    return triaged.select("doc_id", "file_name", "status", "reason", "excluded_by")


def response_log(attached: DataFrame, run_ts: str) -> DataFrame:
    """``doc_id, file_name, logged_at, body``, with a notice where no reply came."""
    logged_at = F.date_format(F.to_timestamp(F.lit(run_ts)), fv.LOG_TIME_FORMAT)
    body = F.coalesce(F.nullif(F.col("response"), F.lit("")), F.lit(fv.NO_RESPONSE_NOTICE))
    return attached.select("doc_id", "file_name", logged_at.alias("logged_at"), body.alias("body"))


def log_heading(spark: SparkSession, run_ts: str, backend: str, model: str) -> DataFrame:
    """The opening of a run's log, a row like those of ``response_log`` without a document."""
    logged_at = F.date_format(F.to_timestamp(F.lit(run_ts)), fv.LOG_TIME_FORMAT)
    return spark.range(1).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("file_name"),
        logged_at.alias("logged_at"),
        F.format_string(fv.LOG_HEADING, logged_at, F.lit(backend), F.lit(model)).alias("body"),
    )


def log_text(log: DataFrame) -> DataFrame:
    """The log as text records, ready for a text sink: ``doc_id, value``. A heading is a record as it is."""
    record = F.format_string(
        f"\n\n{fv.LOG_RULE}\nPDF: %s\nTime: %s\n{fv.LOG_RULE}\n\n%s",
        F.col("file_name"), F.col("logged_at"), F.col("body"),
    )
    heading = F.col("file_name").isNull() & F.col("doc_id").isNull()
    return log.select("doc_id", F.when(heading, F.col("body")).otherwise(record).alias("value"))


def text_previews(documents: DataFrame) -> DataFrame:
    """``doc_id, file_name, preview`` of every document that has a text."""
    return documents.where(F.col("text") != "").select(
        "doc_id", "file_name", preview(F.col("text")).alias("preview")
    )


def artifacts(previews: DataFrame, attached: DataFrame, prompt: str) -> DataFrame:
    """``doc_id, artifact, content``: the prompt, the opening of the text, the reply.

    Each kind reads its own columns. The openings of the texts come straight
    from the scan and do not pass the join with the replies.
    """
    def kind(rows: DataFrame, suffix: str, content: Column) -> DataFrame:
        name = F.concat(file_stem(F.col("file_name")), F.lit(f"_{suffix}.txt"))
        return rows.select("doc_id", name.alias("artifact"), content.alias("content"))

    with_reply = attached.where(F.col("response") != "")
    return (
        kind(attached, "prompt", F.lit(prompt))
        .unionByName(kind(previews, "pdf_extract", F.col("preview")))
        .unionByName(kind(with_reply, "response", F.col("response")))
    )
