"""Many reviews in one job: questionnaires are rows of tables, not code of a plan.

``reviews`` holds ``review_id, cutoff``; ``questions`` ``review_id, ord, id, question, scores``; ``fields``
``review_id, ord, field_key, description``; ``excluding`` ``review_id, ord, id``. A review's questionnaire is
small; there may be any number of reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.operators.parsing import parse_extraction, parse_quality
from papersieve.operators.triage import decided_by, excluded_by_any, passes_cutoff


def _questionnaires(reviews: DataFrame, excluding: DataFrame) -> DataFrame:
    """``review_id, cutoff, excluding``, one row for each review."""
    first = F.sort_array(F.collect_list(F.struct("ord", "id")))
    ids = excluding.groupBy("review_id").agg(F.transform(first, lambda e: e["id"]).alias("excluding"))
    return reviews.select("review_id", F.col("cutoff").cast("double").alias("cutoff")).join(ids, "review_id", "left")


def review_many(
    replies: DataFrame, reviews: DataFrame, excluding: DataFrame, id_pattern: str = fv.QUESTION_ID
) -> DataFrame:
    """Decisions for rows of ``review_id, doc_id, file_name, has_text, response``, each by its own review.

    Replies meet their questionnaire in one join and are parsed behind it, so that what
    has been read from a reply is never shuffled along with it; a review with most of the replies is
    left to Spark's skew handling, which may split it. A reply to an unknown review is
    never decided: its status is NULL. The columns are those of ``review``, and ``cutoff``.
    """
    known = _questionnaires(reviews, excluding).withColumn("_known", F.lit(True))
    parsed = parse_extraction(parse_quality(replies.join(known, "review_id", "left"), id_pattern=id_pattern))
    last = ("cutoff", "excluding", "_known")
    asked = parsed.select(*[c for c in parsed.columns if c not in last], *last)
    decided = decided_by(
        asked,
        lambda items, ids: excluded_by_any(items, ids, F.col("excluding")),
        lambda total: passes_cutoff(total, F.col("cutoff")),
    )
    known = F.coalesce(F.col("_known"), F.lit(False))
    return decided.withColumn("status", F.when(known, F.col("status"))).withColumn(
        "reason", F.when(known, F.col("reason"))
    ).drop("_known", "excluding")


def _answers(decided: DataFrame, asked: DataFrame, items: str, name: str) -> DataFrame:
    """``review_id, doc_id`` with an element of ``asked`` and the last of ``items`` with the same ``name``."""
    first = F.sort_array(F.collect_list(F.struct("ord", *[c for c in asked.columns if c not in ("review_id", "ord")])))
    rows = decided.select(
        "review_id", "doc_id", F.reverse(items).alias("_items"),
    ).withColumn("_names", F.col(f"_items.{name}"))
    return rows.join(asked.groupBy("review_id").agg(first.alias("_asked")), "review_id").select(
        "review_id", "doc_id", "_items", "_names", F.explode("_asked").alias("_of")
    )


def _last(name: Column) -> Column:
    return F.get(F.col("_items"), (F.array_position("_names", name) - 1).cast("int"))


def quality_answers(decided: DataFrame, questions: DataFrame) -> DataFrame:
    """``review_id, doc_id, ord, id, question, answer, score, allowed``: each question of each reply that was parsed.

    Long, since every review has its own header. An absent answer is empty, its score and
    ``allowed`` are NULL; of a repeated question the last answer counts.
    """
    parsed = decided.where(F.col("status").isin(*fv.DECIDED))
    rows = _answers(parsed, questions.select("review_id", "ord", "id", "question", "scores"), "qa_items", "qid")
    item = _last(F.col("_of.id"))
    return rows.select(
        "review_id", "doc_id", "_of.ord", "_of.id", "_of.question",
        F.coalesce(item["descr"], F.lit("")).alias("answer"), item["score"].alias("score"),
        F.array_contains(F.col("_of.scores"), item["score"]).alias("allowed"),
    )


def field_values(decided: DataFrame, fields: DataFrame) -> DataFrame:
    """``review_id, doc_id, ord, field_key, value``: each field of each accepted reply that has any."""
    accepted = decided.where((F.col("status") == fv.ANALYSED) & (F.size("de_items") > 0))
    rows = _answers(accepted, fields.select("review_id", "ord", "field_key"), "de_items", "key")
    value = F.coalesce(_last(F.col("_of.field_key"))["value"], F.lit(""))
    return rows.select("review_id", "doc_id", "_of.ord", "_of.field_key", value.alias("value"))
