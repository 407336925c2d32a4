"""The whole review: replies to decisions, and decisions to report tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersieve import fixed_values as fv
from papersieve.functions.places import from_places, stored_item, to_places
from papersieve.functions.text import preview
from papersieve.operators.inference import attach_responses, without_text
from papersieve.operators.parsing import computed_once, parse_extraction, parse_quality
from papersieve.operators.reports import (
    artifacts,
    extraction_report,
    log_heading,
    manifest,
    quality_report,
    response_log,
)
from papersieve.operators.triage import triage
from papersieve.schema import ReviewSchema
from papersieve.sources.corpus import pending_documents
from papersieve.sources.reports import write_headers
from papersieve.sources.runs import RUN_ID, clear, commit, new_run_id, snapshot, vacuum, valid_rows
from papersieve.sources.storage import shuffles_removed

BROADCAST_IDS = 2_000_000
"""Ids that are broadcast to find pending documents, some 32 MB."""
ZSTD_LEVEL = 5
ANSWERS = {"qa_items": "descr", "de_items": "value"}
"""Columns of the decisions whose items hold texts of the reply, and in which field."""


class Reports(NamedTuple):
    """Where a run has written its tables."""

    decisions: str
    qa_report: str
    de_report: str
    manifest: str
    response_log: str
    artifacts: str


def review_replies(
    attached: DataFrame,
    schema: ReviewSchema,
    id_pattern: str = fv.QUESTION_ID,
    strict_keys: bool = False,
) -> DataFrame:
    """Decisions for rows of ``doc_id, file_name, has_text, response``.

    Works row by row, on a batch or on a stream. With ``strict_keys`` a marked
    section is split at the keys of the schema only.
    """
    keys = schema.field_keys if strict_keys else None
    return triage(parse_extraction(parse_quality(attached, id_pattern=id_pattern), keys=keys), schema)


def review(
    documents: DataFrame,
    responses: DataFrame,
    schema: ReviewSchema,
    id_pattern: str = fv.QUESTION_ID,
    strict_keys: bool = False,
) -> DataFrame:
    """Decisions for documents and their recorded replies; one join is all it shuffles."""
    attached = attach_responses(without_text(documents), responses)
    return review_replies(attached, schema, id_pattern, strict_keys)


def report_paths(folder: str) -> Reports:
    return Reports(*[f"{folder.rstrip('/')}/{name}" for name in Reports._fields])


def scan_documents(documents: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``doc_id, file_name, has_text, preview`` of the documents that ``earlier`` has not decided.

    One scan reads the texts, and nothing of them is shuffled where either the
    pending or the decided ids are few enough to broadcast; they are counted first, without
    reading texts. Beyond ``BROADCAST_IDS`` of both, openings of texts are shuffled.
    """
    readable = F.coalesce(F.col("text") != "", F.lit(False))
    has_text = F.col("has_text") if "has_text" in documents.columns else readable
    opening = F.when(readable, preview(F.col("text")))
    scanned = documents.select("doc_id", "file_name", has_text.alias("has_text"), opening.alias("preview"))
    if earlier is None:
        return scanned
    ids = documents.select("doc_id")
    decided = earlier.where(F.col("status").isin(*fv.DECIDED)).select("doc_id").distinct()
    if decided.count() <= BROADCAST_IDS:
        return scanned.join(F.broadcast(decided), "doc_id", "left_anti")
    pending = pending_documents(ids, earlier).distinct()
    if pending.count() <= BROADCAST_IDS:
        # a document without an id was never decided
        return scanned.join(F.broadcast(pending), scanned["doc_id"].eqNullSafe(pending["doc_id"]), "left_semi")
    # fixed first, or the join would be moved below and take the texts along
    return pending_documents(computed_once(scanned, "has_text", "preview"), earlier)


def wanted_replies(responses: DataFrame, todo: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """``responses`` without those that no document of ``todo`` can take, if few ids tell so.

    Replies are shuffled to meet their documents, so what is known to be left out goes
    before. The ids of ``todo`` are broadcast, or those that ``earlier`` has decided; beyond
    ``BROADCAST_IDS`` of both all replies are kept.
    """
    asked = todo.where("has_text").select("doc_id").distinct()
    if asked.count() <= BROADCAST_IDS:
        return responses.join(F.broadcast(asked), "doc_id", "left_semi")
    if earlier is not None:
        decided = earlier.where(F.col("status").isin(*fv.DECIDED)).select("doc_id").distinct()
        if decided.count() <= BROADCAST_IDS:
            return responses.join(F.broadcast(decided), "doc_id", "left_anti")
    return responses


def _item(columns: T.StructType, name: str) -> T.StructType:
    return columns[name].dataType.elementType


def short_decisions(decided: DataFrame) -> DataFrame:
    """Decisions as they are stored: what a reply answers as places in the reply, which stands beside it."""
    return decided.withColumns({
        name: to_places(F.col(name), _item(decided.schema, name), text, F.col("response"))
        for name, text in ANSWERS.items()
    })


def whole_decisions(stored: DataFrame, columns: T.StructType, *names: str) -> DataFrame:
    """Decisions with the ``columns`` that ``short_decisions`` was given, or some; only ``names`` have their texts, if there are any."""
    names = names or tuple(name for name in ANSWERS if name in columns.names)
    if not names:
        return stored.select(*columns.names)
    told = stored.withColumns({
        name: from_places(F.col(name), _item(columns, name), ANSWERS[name], F.col("response")) for name in names
    })
    return computed_once(told, *names).select(*columns.names)


def _stored_columns(columns: T.StructType) -> T.StructType:
    """The columns of ``short_decisions`` for those of the decisions."""
    return T.StructType([
        T.StructField(field.name, T.ArrayType(stored_item(_item(columns, field.name)))) if field.name in ANSWERS else field
        for field in columns.fields
    ])


def write_run(
    documents: DataFrame,
    responses: DataFrame,
    schema: ReviewSchema,
    folder: str,
    run_ts: str,
    source: str = "parquet",
    earlier: DataFrame | None = None,
    id_pattern: str = fv.QUESTION_ID,
    options: dict[str, str] | None = None,
    strict_keys: bool = False,
    backend: tuple[str, str] | None = None,
) -> str:
    """Write every table of a run below ``folder`` and return its id; nothing counts before ``commit``.

    Documents are scanned once, into a table of ids and openings. The decisions are written
    next, and the reports read them from there: replies are parsed once, a
    lost executor costs only its own tasks, and a report reads only the
    statuses it shows. Decisions hold the replies, and their answers as places in these; they are written by the tasks that made
    them, a file for each status, and not shuffled again. Openings are removed as soon as the artifacts
    hold them, shuffled rows as soon as a table is written. The headers of the reports are a table as well. With a ``backend``, its address and model, the log opens with a
    heading.
    """
    spark, run_id = documents.sparkSession, new_run_id()
    paths = report_paths(folder)

    def write(
        table: DataFrame,
        path: str,
        *partitions: str,
        source: str = source,
        options: dict[str, str] = options or {},
    ) -> None:
        writer = table.withColumn("run_ts", F.lit(run_ts)).write.format(source)
        if source == "parquet":  # texts are in most tables, and take a third less than by Spark's default
            writer = writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD_LEVEL)
        writer = writer.options(**options)
        with shuffles_removed(spark):
            writer.mode("errorifexists").partitionBy("run_ts", *partitions).save(f"{path}/{RUN_ID}={run_id}")

    scanned = scan_documents(documents, earlier)
    write(scanned, scanned_path(folder), source="parquet", options={})
    known = _read_back(spark, scanned_path(folder), scanned.schema, run_id)
    todo = known.select("doc_id", "file_name", "has_text")

    wanted = wanted_replies(responses, todo, earlier)
    decided = review_replies(attach_responses(todo, wanted), schema, id_pattern, strict_keys)
    write(short_decisions(decided), paths.decisions, "status", source="parquet", options={})
    decisions = _read_back(spark, paths.decisions, _stored_columns(decided.schema), run_id)

    previews = known.where("preview IS NOT NULL").select("doc_id", "file_name", "preview")
    write(artifacts(previews, decisions, schema.prompt()), paths.artifacts)
    clear(spark, f"{scanned_path(folder)}/{RUN_ID}={run_id}")
    scored = whole_decisions(decisions, decided.schema, "qa_items")
    write(quality_report(scored, schema, "doc_id"), paths.qa_report)
    filled = whole_decisions(decisions, decided.schema, "de_items")
    write(extraction_report(filled, schema, "doc_id"), paths.de_report)
    log = response_log(decisions, run_ts)
    if backend:
        log = log_heading(spark, run_ts, *backend).unionByName(log)
    write(log, paths.response_log)
    # few bytes a document, so a task would leave a small file for each status
    write(manifest(decisions).hint("rebalance", "status"), paths.manifest, "status")
    headers = {"qa_report": schema.qa_header(), "de_report": schema.de_header()}
    write_headers(spark, folder, run_id, headers)
    return run_id


def run_review(
    documents: DataFrame,
    responses: DataFrame,
    schema: ReviewSchema,
    folder: str,
    run_ts: str,
    mode: str = "overwrite",
    source: str = "parquet",
    earlier: DataFrame | None = None,
    id_pattern: str = fv.QUESTION_ID,
    options: dict[str, str] | None = None,
    strict_keys: bool = False,
    keep_former: bool = False,
    backend: tuple[str, str] | None = None,
) -> Reports:
    """Review what is pending and write every report table below ``folder``, to count as a whole.

    Tables are written by ``write_run``; one commit at the end makes all of them
    count at once. Until then, and if the run breaks off, ``read_report`` and ``read_manifest`` give the
    former runs whole, and all documents of this one are pending still.

    ``overwrite`` lets this run alone count. ``append`` keeps the other runs and
    replaces only those of this ``run_ts``, so it can be repeated.
    ``earlier`` is the manifest of former runs, see ``read_manifest``. ``source``
    and ``options`` are the format of the reports; the decisions are Parquet.
    What no longer counts is removed at the end, remains of broken runs
    as well, unless ``keep_former``; ``vacuum`` removes it later. One run at a
    time may write to a folder; the second of two is refused.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode}")
    spark = documents.sparkSession
    before = snapshot(spark, folder)
    run_id = write_run(
        documents, responses, schema, folder, run_ts, source, earlier, id_pattern, options, strict_keys, backend
    )
    kept = {run: ts for run, ts in before.runs.items() if mode == "append" and ts != run_ts}
    commit(spark, folder, before, {**kept, run_id: run_ts})
    if not keep_former:
        vacuum(spark, folder)
    return report_paths(folder)


def scanned_path(folder: str) -> str:
    """Where a run keeps ids and openings of texts while it is being written."""
    return f"{folder.rstrip('/')}/scanned"


def _read_back(spark: SparkSession, path: str, columns: T.StructType, run_id: str) -> DataFrame:
    """What a run has just written. Giving the columns keeps ``run_ts`` text."""
    stored = T.StructType([*columns.fields, T.StructField("run_ts", T.StringType())])
    return spark.read.schema(stored).parquet(f"{path}/{RUN_ID}={run_id}").select(*columns.names)


def read_decisions(
    spark: SparkSession, path: str, columns: T.StructType, run_ts: str
) -> DataFrame:
    """The written decisions of one run that counts."""
    text = T.StringType()
    kept = _stored_columns(columns).fields
    if "response" not in columns.names:  # answers are places in it
        kept = [*kept, T.StructField("response", text)]
    stored = T.StructType([*kept, T.StructField("run_ts", text), T.StructField(RUN_ID, text)])
    rows = spark.read.schema(stored).parquet(path).where(F.col("run_ts") == run_ts)
    return whole_decisions(valid_rows(rows, path.rstrip("/").rpartition("/")[0]), columns)
