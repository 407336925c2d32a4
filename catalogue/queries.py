"""Every registered query: ``name -> (spark, folder) -> DataFrame``.

All of them read whole tables of the folder, or tables that Spark derives from
them row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import samples
from catalogue.sample_schema import LATER_SCHEMA, SCHEMA
from papersieve.functions.text import file_stem, preview, truncate
from papersieve.operators import inference, parsing, reports, requests
from papersieve.operators.triage import excluded_by_join
from papersieve.plans.many import field_values, quality_answers, review_many
from papersieve.plans.review import report_paths, review, run_review, write_run
from papersieve.sources.corpus import pending_documents, with_text
from papersieve.sources.reports import read_across_runs, read_manifest, read_report
from papersieve.sources.storage import shared_folder
from papersieve.streaming.attempts import read_outcomes, start_attempts, wait_for_input
from papersieve.streaming.review import REPLY, read_review, start_review

Query = Callable[[SparkSession, str], DataFrame]
RUN_TS = "2024-05-06 07:08:09"
NEXT_RUN_TS = "2024-05-07 07:08:09"
MODEL = "sample-model"
BACKEND = "http://backend.example/v1"
CONTENT_LIMIT = 2000


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    return samples.replies(samples.described(spark, folder))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse_quality(_replies(spark, folder))


def _extraction(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.parse_extraction(_replies(spark, folder))


def _reviewed(spark: SparkSession, folder: str) -> DataFrame:
    return review(samples.known_papers(spark, folder), _replies(spark, folder), SCHEMA)


def _reviewed_all_readable(spark: SparkSession, folder: str) -> DataFrame:
    """The review where every document has a text: title, exclusion, cutoff."""
    documents = samples.named(samples.document_ids(spark, folder))
    known = documents.withColumn("has_text", F.lit(True))
    return review(known, _replies(spark, folder), SCHEMA)


# Sources ----------------------------------------------------------------------

def pending(spark: SparkSession, folder: str) -> DataFrame:
    ids = samples.document_ids(spark, folder)
    return pending_documents(samples.named(ids), samples.earlier_manifest(ids))


def assemble_pages(spark: SparkSession, folder: str) -> DataFrame:
    texts = samples.documents(spark, folder)
    return with_text(samples.document_ids(spark, folder), samples.pages(texts)).select(
        "doc_id", "text"
    )


def schema_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Items of all replies against the question table: use and misuse of each id."""
    items = parsing.quality_long(_quality(spark, folder), "doc_id")
    # the questions come along as rows that count nothing, so one shuffle is enough
    asked = SCHEMA.questions_table(spark).withColumnRenamed("id", "qid")
    lists = F.broadcast(asked.select("qid", "scores"))
    allowed = F.coalesce(F.array_contains("scores", F.col("score")), F.lit(False))
    counted = items.join(lists, "qid", "left").select(
        "qid", F.lit(1).alias("n"), F.when(allowed, 0).otherwise(1).alias("other"),
        F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("question"),
    )
    unasked = asked.select("qid", F.lit(0), F.lit(0), F.col("ord").cast("bigint"), "question")
    return counted.unionAll(unasked).groupBy("qid").agg(
        F.max("ord").alias("ord"), F.max("question").alias("question"),
        F.sum("n").alias("n_items"), F.sum("other").alias("n_other_scores"),
    )


def schema_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of all replies against the field table: how often each is filled."""
    fields = parsing.extraction_long(_extraction(spark, folder), "doc_id")
    counted = fields.groupBy("key").agg(F.count_if(F.col("value") != "").alias("n_filled"))
    wanted = SCHEMA.fields_table(spark)
    return wanted.join(counted, "key", "left").select(
        F.col("ord").cast("bigint").alias("ord"), "key", "description",
        F.coalesce("n_filled", F.lit(0)).alias("n_filled"),
    )


# Prompts, requests, replies ---------------------------------------------------

def preview_text(spark: SparkSession, folder: str) -> DataFrame:
    return samples.documents(spark, folder).select(
        "doc_id", preview(F.col("text")).alias("preview")
    )


def truncate_content(spark: SparkSession, folder: str) -> DataFrame:
    return samples.documents(spark, folder).select(
        "doc_id", truncate(F.col("text"), CONTENT_LIMIT).alias("content")
    )


def render_prompt(spark: SparkSession, folder: str) -> DataFrame:
    return requests.render_prompts(*samples.review_tables(spark, folder))


def compose_prompt(spark: SparkSession, folder: str) -> DataFrame:
    message = requests.full_prompt(F.col("text"), SCHEMA.prompt())
    return (
        samples.named(samples.documents(spark, folder))
        .select("doc_id", message.alias("message"))
        .select(
            "doc_id",
            F.length("message").cast("bigint").alias("n_chars"),
            F.md5("message").alias("message_md5"),
        )
    )


def chat_payload(spark: SparkSession, folder: str) -> DataFrame:
    documents = samples.named(samples.documents(spark, folder))
    sent = requests.requests(documents, SCHEMA.prompt(), MODEL)
    shape = (
        "model string, messages array<struct<role:string,content:string>>, "
        "temperature double, max_tokens bigint, stream boolean"
    )
    return (
        sent.select("doc_id", F.from_json("payload", shape).alias("p"))
        .select(
            "doc_id", "p.model", "p.temperature", "p.max_tokens", "p.stream",
            F.array_join("p.messages.role", ",").alias("roles"),
            F.element_at("p.messages", 1)["content"].alias("system_message"),
            F.md5(F.element_at("p.messages", 2)["content"]).alias("user_md5"),
        )
    )


def extract_reply(spark: SparkSession, folder: str) -> DataFrame:
    return samples.bodies(samples.document_ids(spark, folder)).select(
        "doc_id", requests.extract_reply(F.col("body")).alias("reply")
    )


# Inference --------------------------------------------------------------------

def resolve_attempts(spark: SparkSession, folder: str) -> DataFrame:
    resolved = inference.resolve_attempts(samples.attempts(spark, folder))
    return resolved.select(
        "doc_id", "outcome", F.col("n_attempts").cast("bigint").alias("n_attempts"),
        F.col("status_code").cast("bigint").alias("status_code"), "error_kind",
        requests.extract_reply(F.col("body")).alias("reply"),
    )


def backoff_cost(spark: SparkSession, folder: str) -> DataFrame:
    resolved = inference.resolve_attempts(samples.attempts(spark, folder))
    return inference.backoff_cost(resolved).withColumn(
        "n_attempts", F.col("n_attempts").cast("bigint")
    )


def attach_responses(spark: SparkSession, folder: str) -> DataFrame:
    documents = samples.papers(samples.documents(spark, folder))
    return inference.attach_responses(
        inference.without_text(documents), _replies(spark, folder)
    )


def conversation_batches(spark: SparkSession, folder: str) -> DataFrame:
    return inference.conversation_batches(samples.named(samples.document_ids(spark, folder)))


# Quality items ----------------------------------------------------------------

def _long_items(parsed: DataFrame) -> DataFrame:
    return parsing.quality_long(parsed, "doc_id", "qa_strategy").withColumn(
        "ord", F.col("ord").cast("bigint")
    )


def qa_items(spark: SparkSession, folder: str) -> DataFrame:
    return _long_items(_quality(spark, folder))


def qa_total(spark: SparkSession, folder: str) -> DataFrame:
    return _quality(spark, folder).select("doc_id", "qa_strategy", "qa_failed", "total_score")


def qa_wide(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.quality_wide(_quality(spark, folder), SCHEMA, "doc_id")


def qa_checks(spark: SparkSession, folder: str) -> DataFrame:
    checked = parsing.check_items(_quality(spark, folder), SCHEMA)
    return checked.select(
        "doc_id", F.array_join("unknown_ids", ",").alias("unknown_ids"), "score_in_range"
    )


def qa_positional(spark: SparkSession, folder: str) -> DataFrame:
    replies = samples.glued_replies(samples.document_ids(spark, folder))
    parsed = parsing.parse_quality(replies)
    return parsing.quality_long(parsed, "doc_id", "qa_strategy", "total_score").withColumn(
        "ord", F.col("ord").cast("bigint")
    )


def qa_unmarked(spark: SparkSession, folder: str) -> DataFrame:
    replies = samples.loose_replies(samples.document_ids(spark, folder))
    return _long_items(parsing.parse_quality(replies))


def qa_quoted_text(spark: SparkSession, folder: str) -> DataFrame:
    replies = samples.quality_quotes(samples.documents(spark, folder))
    return _long_items(parsing.parse_quality(replies))


# Extraction fields ------------------------------------------------------------

def _long_fields(parsed: DataFrame, key: str = "doc_id") -> DataFrame:
    return parsing.extraction_long(parsed, key, "de_strategy").withColumn(
        "ord", F.col("ord").cast("bigint")
    )


def de_items(spark: SparkSession, folder: str) -> DataFrame:
    return _long_fields(_extraction(spark, folder))


def de_wide(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.extraction_wide(_extraction(spark, folder), SCHEMA, "doc_id", "de_strategy")


def de_unmarked(spark: SparkSession, folder: str) -> DataFrame:
    replies = samples.page_listings(spark, folder)
    return _long_fields(parsing.parse_extraction(replies), "page_id")


def de_title_rescue(spark: SparkSession, folder: str) -> DataFrame:
    replies = samples.lone_titles(samples.document_ids(spark, folder))
    return _long_fields(parsing.parse_extraction(replies))


def de_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Fields by the keys of the schema alone, where values end in capitals."""
    replies = samples.capital_values(spark, folder)
    return _long_fields(parsing.parse_extraction(replies, keys=SCHEMA.field_keys))


def de_quoted_text(spark: SparkSession, folder: str) -> DataFrame:
    replies = samples.field_quotes(samples.documents(spark, folder))
    return _long_fields(parsing.parse_extraction(replies))


# Triage -----------------------------------------------------------------------

def resolve_title(spark: SparkSession, folder: str) -> DataFrame:
    ids = samples.document_ids(spark, folder)
    known = samples.named(ids).withColumn("has_text", F.lit(True))
    decided = review(known, samples.title_fields(ids), SCHEMA)
    return decided.select(
        "doc_id", "title", "has_title", file_stem(F.col("file_name")).alias("stem")
    )


def excluded(spark: SparkSession, folder: str) -> DataFrame:
    return _reviewed_all_readable(spark, folder).select("doc_id", "excluded_by")


def excluded_as_join(spark: SparkSession, folder: str) -> DataFrame:
    items = parsing.quality_long(_quality(spark, folder), "doc_id")
    return excluded_by_join(items, SCHEMA.excluding_table(spark), "doc_id")


def cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return _reviewed_all_readable(spark, folder).select("doc_id", "total_score", "passes_cutoff")


def triage(spark: SparkSession, folder: str) -> DataFrame:
    return _reviewed(spark, folder).select(
        "doc_id", "title", "total_score", "status", "reason", "excluded_by"
    )


# Reports ----------------------------------------------------------------------

def qa_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.quality_report(_reviewed(spark, folder), SCHEMA, "doc_id")


def de_report(spark: SparkSession, folder: str) -> DataFrame:
    return reports.extraction_report(_reviewed(spark, folder), SCHEMA, "doc_id")


def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    decided = reports.manifest(_reviewed(spark, folder))
    return decided.groupBy("status", "reason").agg(F.count("*").alias("n_documents"))


def response_log(spark: SparkSession, folder: str) -> DataFrame:
    attached = attach_responses(spark, folder)
    return reports.response_log(attached, RUN_TS)


def response_log_text(spark: SparkSession, folder: str) -> DataFrame:
    heading = reports.log_heading(spark, RUN_TS, BACKEND, MODEL)
    return reports.log_text(heading.unionByName(response_log(spark, folder)))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    documents = samples.papers(samples.documents(spark, folder))
    attached = attach_responses(spark, folder)
    return reports.artifacts(
        reports.text_previews(documents), attached, SCHEMA.prompt()
    ).select(
        "doc_id", "artifact",
        F.length("content").cast("bigint").alias("n_chars"),
        F.md5("content").alias("content_md5"),
    )


def report_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The quality report as it is read back after a whole run has been written."""
    out = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    paths = run_review(
        samples.papers(samples.documents(spark, folder)), _replies(spark, folder), SCHEMA, out,
        RUN_TS,
    )
    keys = T.StructType([T.StructField("doc_id", T.LongType())])
    return read_report(spark, paths.qa_report, SCHEMA.qa_header(), keys)


def run_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """What counts after a run on a third of the documents, one on the rest, that again, and a broken one."""
    out = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    documents, replies = samples.papers(samples.documents(spark, folder)), _replies(spark, folder)
    known = report_paths(out).manifest
    run_review(documents.where("doc_id % 3 = 0"), replies, SCHEMA, out, RUN_TS, mode="append", keep_former=True)
    first = read_manifest(spark, known).where(F.col("run_ts") == RUN_TS)
    for _ in range(2):  # the second time replaces what the first has written
        run_review(documents, replies, SCHEMA, out, NEXT_RUN_TS, mode="append", earlier=first, keep_former=True)
    write_run(documents, replies, SCHEMA, out, RUN_TS)  # never committed
    return read_manifest(spark, known).select("doc_id", "run_ts", "status")


def report_across_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Quality reports of two runs with different questionnaires, read as one table."""
    out = f"{shared_folder(spark)}/review-{uuid.uuid4().hex}"
    documents, replies = samples.papers(samples.documents(spark, folder)), _replies(spark, folder)
    for rest, schema, run_ts in ((0, SCHEMA, RUN_TS), (1, LATER_SCHEMA, NEXT_RUN_TS)):
        run_review(documents.where(F.col("doc_id") % 2 == rest), replies, schema, out, run_ts, mode="append", keep_former=True)
    return read_across_runs(spark, out, "qa_report")


# Many reviews -----------------------------------------------------------------

def _many(spark: SparkSession, folder: str) -> DataFrame:
    reviews, _, _ = samples.review_tables(spark, folder)
    cutoffs = reviews.withColumn("cutoff", F.col("cutoff") / 1000)
    return review_many(samples.line_replies(spark, folder), cutoffs, samples.urgent_orders(spark, folder))


def many_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer is a review, its orders are the questions, its line numbers the documents."""
    return _many(spark, folder).select(
        "review_id", "doc_id", "total_score", "excluded_by", "status", "reason"
    )


def many_answers(spark: SparkSession, folder: str) -> DataFrame:
    _, questions, _ = samples.review_tables(spark, folder)
    return quality_answers(_many(spark, folder), questions).drop("ord")


def many_fields(spark: SparkSession, folder: str) -> DataFrame:
    _, _, fields = samples.review_tables(spark, folder)
    return field_values(_many(spark, folder), fields)


# Streams ----------------------------------------------------------------------

def review_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of a stream that is started twice: beginnings of replies to odd documents, then all replies."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    replies = _replies(spark, folder).select("doc_id", "response")
    whole = samples.known_papers(spark, folder).join(replies, "doc_id").select(
        "doc_id", "file_name", "has_text", "response"
    )
    begun = F.when(F.col("doc_id") % 2 == 1, F.left("response", F.lit(40))).otherwise(F.col("response"))
    for delivery in (whole.withColumn("response", begun), whole):
        delivery.write.mode("append").parquet(f"{out}/replies")
        stream = spark.readStream.schema(REPLY).parquet(f"{out}/replies")
        start_review(stream, SCHEMA, f"{out}/decisions", f"{out}/checkpoint").awaitTermination()
    return read_review(spark, f"{out}/decisions", SCHEMA).select(
        "doc_id", "title", "total_score", "status", "reason", "excluded_by"
    )


def attempts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of attempts that arrive in two deliveries, the later ones first."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    attempts = samples.attempts(spark, folder)
    for delivery in (attempts.where("attempt > 2"), attempts.where("attempt <= 2")):
        delivery.write.mode("append").parquet(f"{out}/attempts")
        stream = spark.readStream.schema(inference.ATTEMPT_TYPE).parquet(f"{out}/attempts")
        running = start_attempts(stream, f"{out}/outcomes", f"{out}/checkpoint", every="1 second")
        try:
            wait_for_input(running)
        finally:
            running.stop()
    return read_outcomes(spark, f"{out}/outcomes").select(
        "doc_id", "outcome", F.col("n_attempts").cast("bigint").alias("n_attempts"),
        F.col("status_code").cast("bigint").alias("status_code"), "error_kind",
        requests.extract_reply(F.col("body")).alias("reply"),
    )


QUERIES: dict[str, Query] = {
    "pending_documents": pending,
    "assemble_pages": assemble_pages,
    "schema_questions": schema_questions,
    "schema_fields": schema_fields,
    "preview": preview_text,
    "truncate_content": truncate_content,
    "render_prompt": render_prompt,
    "compose_prompt": compose_prompt,
    "chat_payload": chat_payload,
    "extract_reply": extract_reply,
    "resolve_attempts": resolve_attempts,
    "backoff_cost": backoff_cost,
    "attach_responses": attach_responses,
    "conversation_batches": conversation_batches,
    "qa_items": qa_items,
    "qa_total": qa_total,
    "qa_wide": qa_wide,
    "qa_checks": qa_checks,
    "qa_positional": qa_positional,
    "qa_unmarked": qa_unmarked,
    "qa_quoted_text": qa_quoted_text,
    "de_items": de_items,
    "de_strict": de_strict,
    "de_wide": de_wide,
    "de_unmarked": de_unmarked,
    "de_title_rescue": de_title_rescue,
    "de_quoted_text": de_quoted_text,
    "resolve_title": resolve_title,
    "excluded": excluded,
    "excluded_as_join": excluded_as_join,
    "cutoff": cutoff,
    "triage": triage,
    "qa_report": qa_report,
    "de_report": de_report,
    "manifest_counts": manifest_counts,
    "response_log": response_log,
    "response_log_text": response_log_text,
    "artifacts": artifacts,
    "report_round_trip": report_round_trip,
    "run_snapshot": run_snapshot,
    "report_across_runs": report_across_runs,
    "many_reviews": many_reviews,
    "many_answers": many_answers,
    "many_fields": many_fields,
    "review_stream": review_stream,
    "attempts_stream": attempts_stream,
}
