"""Rendering prompts, composing requests and reading reply bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions.text import truncate


def render_prompts(
    reviews: DataFrame, questions: DataFrame, fields: DataFrame, key: str = "review_id"
) -> DataFrame:
    """``key, prompt`` for a table of reviews, whose schemas are tables as well.

    ``reviews(key, cutoff)``, ``questions(key, ord, id, question, scores)`` and
    ``fields(key, ord, field_key, description)``. A review without questions or
    without fields has an empty prompt. For one review kept on the driver,
    ``ReviewSchema.prompt`` gives the same text.
    """
    scores = F.array_join(F.transform("scores", lambda s: s.cast("string")), ", ")
    question_line = F.format_string(
        "* %s: %s (Possible scores: %s)\n", F.col("id"), F.col("question"), scores
    )
    field_line = F.format_string("* %s: %s\n", F.col("field_key"), F.col("description"))
    in_order = "listagg(line, '') WITHIN GROUP (ORDER BY ord)"
    asked = (
        questions.select(key, "ord", question_line.alias("line"))
        .groupBy(key).agg(F.expr(in_order).alias("_questions"))
    )
    wanted = (
        fields.select(key, "ord", field_line.alias("line"))
        .groupBy(key).agg(F.expr(in_order).alias("_fields"))
    )
    prompt = F.concat(
        F.lit(fv.PROMPT_OPENING), F.col("_questions"),
        F.lit(fv.PROMPT_FIELDS_HEADING), F.col("_fields"),
        F.lit(fv.PROMPT_CUTOFF), F.col("cutoff").cast("string"), F.lit(fv.PROMPT_CLOSING),
    )
    return (
        reviews.join(asked.hint("merge"), key, "left").join(wanted.hint("merge"), key, "left")
        .select(key, F.coalesce(prompt, F.lit("")).alias("prompt"))
    )


def full_prompt(text: Column, prompt: str, max_content_length: int | None = None) -> Column:
    """The user message: the document, then the task. Without a text, the task alone."""
    both = F.concat(
        F.lit(fv.CONTENT_HEADING), truncate(text, max_content_length),
        F.lit(fv.TASK_HEADING + prompt),
    )
    return F.when(text != "", both).otherwise(F.lit(prompt))


def chat_payload(
    user_message: Column,
    model: str,
    temperature: float = fv.TEMPERATURE,
    max_tokens: int = fv.MAX_TOKENS,
) -> Column:
    """Request body of a chat completion, as JSON text."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(F.struct(
        F.lit(model).alias("model"),
        F.array(
            message("system", F.lit(fv.SYSTEM_MESSAGE)), message("user", user_message)
        ).alias("messages"),
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(False).alias("stream"),
    ))


def requests(
    documents: DataFrame,
    prompt: str,
    model: str,
    max_content_length: int | None = None,
    temperature: float = fv.TEMPERATURE,
    max_tokens: int = fv.MAX_TOKENS,
) -> DataFrame:
    """``doc_id, payload`` for every readable document; others are never sent."""
    message = full_prompt(F.col("text"), prompt, max_content_length)
    return documents.where(F.col("text") != "").select(
        "doc_id", chat_payload(message, model, temperature, max_tokens).alias("payload")
    )


def extract_reply(body: Column) -> Column:
    """Content of the first choice of a reply body, NULL where there is none."""
    parsed = F.from_json(body, "choices array<struct<message:struct<content:string>>>")
    return F.get(parsed["choices"], F.lit(0))["message"]["content"]
