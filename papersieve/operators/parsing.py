"""Parsing replies: layered strategies over the column expressions.

Every step is its own column, so that each pattern runs once per reply however
many later columns use its result. Nothing here shuffles, and nothing throws on
bad input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions import extraction, quality
from papersieve.functions.text import last_with_key
from papersieve.schema import ReviewSchema


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns fixed, so that they are computed once per row.

    A filter on a computed column is pushed below it by copying its definition,
    here whole chains of patterns, which would then run in the filter as well.
    The fields of an inlined struct have no definition to copy.
    """
    others = [f"`{name}`" for name in df.columns if name not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def parse_quality(
    df: DataFrame, response: str = "response", id_pattern: str = fv.QUESTION_ID
) -> DataFrame:
    """Adds ``qa_strategy, qa_items, qa_failed, total_score``.

    With a marked section the items are read by their markers, or by position
    when that finds none; without one the whole reply is searched, and there a
    score that is no number fails the reply: ``qa_failed``, and no items. Without
    a reply all columns are NULL, ``qa_failed`` is false.
    """
    reply = F.nullif(F.col(response), F.lit(""))
    section, marked = F.col("_section"), F.col("_marked")
    strategy = (
        F.when(reply.isNull(), None)
        .when(section.isNull(), "unmarked")
        .when(F.size(marked) > 0, "marked")
        .otherwise("positional")
    )
    parsed = (
        df.withColumn("_section", quality.qa_section(F.col(response)))
        .withColumn("_marked", quality.marked_matches(section, id_pattern))
        .withColumn("qa_strategy", strategy)
        .withColumn(
            "_found",
            F.when(F.col("qa_strategy") == "marked", quality.marked_items(marked))
            .when(
                F.col("qa_strategy") == "positional",
                quality.positional_items(section, id_pattern),
            )
            .when(
                F.col("qa_strategy") == "unmarked",
                quality.unmarked_items(F.col(response), id_pattern),
            ),
        )
        .withColumn(
            "qa_failed",
            F.coalesce(
                (F.col("qa_strategy") == "unmarked")
                & F.exists("_found", lambda item: item["score"].isNull()),
                F.lit(False),
            ),
        )
        .withColumn("qa_items", F.when(~F.col("qa_failed"), F.col("_found")))
        .withColumn("total_score", quality.total_score(F.col("qa_items")))
        .drop("_section", "_marked", "_found")
    )
    return computed_once(parsed, "qa_strategy", "qa_items", "qa_failed", "total_score")


def parse_extraction(
    df: DataFrame, response: str = "response", keys: list[str] | None = None
) -> DataFrame:
    """Adds ``de_strategy, de_items``; both NULL where there is no reply.

    A marked section is read key by key, and searched for a title alone when it
    has no key; without one, the lines below the heading are read. Any capitals
    before a colon are a key, even those that end a value on the line before; with
    ``keys``, only these are.
    """
    reply = F.nullif(F.col(response), F.lit(""))
    section, marked = F.col("_section"), F.col("_marked")
    strategy = (
        F.when(reply.isNull(), None)
        .when(section.isNull(), "unmarked")
        .when(F.size(marked) > 0, "marked")
        .when(extraction.title_found(section), "title")
        .otherwise("none")
    )
    parsed = (
        df.withColumn("_section", extraction.de_section(F.col(response)))
        .withColumn("_marked", _key_spans(section, keys))
        .withColumn("de_strategy", strategy)
        .withColumn(
            "de_items",
            F.when(F.col("de_strategy") == "marked", extraction.marked_fields(marked))
            .when(F.col("de_strategy") == "title", extraction.title_field(section))
            .when(F.col("de_strategy") == "unmarked", extraction.unmarked_fields(F.col(response)))
            .when(F.col("de_strategy") == "none", extraction.no_fields()),
        )
        .drop("_section", "_marked")
    )
    return computed_once(parsed, "de_strategy", "de_items")


def _key_spans(section: Column, keys: list[str] | None) -> Column:
    return extraction.marked_matches(section) if keys is None else extraction.strict_matches(section, keys)


def check_items(parsed: DataFrame, schema: ReviewSchema) -> DataFrame:
    """Adds ``unknown_ids`` and ``score_in_range``; neither changes a total. NULL where nothing was parsed.

    ``unknown_ids`` are the ids outside the schema, each once, in the order of the
    reply. ``score_in_range`` is false if a known id has a score outside its list.
    """
    known = schema.question_ids
    ids = F.array_distinct(F.transform("qa_items", lambda item: item["qid"]))

    def allowed(item: Column) -> Column:
        fits = F.lit(True)
        for question in schema.questions:
            outside = (item["qid"] == question.id) & ~item["score"].isin(*question.scores)
            fits = fits & ~outside
        return fits

    return parsed.withColumn("unknown_ids", F.filter(ids, lambda qid: ~qid.isin(*known))).withColumn(
        "score_in_range", F.forall("qa_items", allowed)
    )


def quality_long(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per item: ``keys, ord, qid, descr, score``."""
    return parsed.select(*keys, F.posexplode("qa_items").alias("ord", "_item")).select(
        *keys, "ord", "_item.qid", "_item.descr", "_item.score"
    )


def extraction_long(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per field: ``keys, ord, key, value``."""
    return parsed.select(*keys, F.posexplode("de_items").alias("ord", "_item")).select(
        *keys, "ord", "_item.key", "_item.value"
    )


def quality_wide(parsed: DataFrame, schema: ReviewSchema, *keys: str) -> DataFrame:
    """``keys, (id, id_SCORE)*, TOTAL_SCORE``; of a repeated id the last counts.

    The columns are looked up in the item array, so no pivot and no shuffle.
    """
    newest = parsed.withColumn("_newest", F.reverse("qa_items")).withColumn(
        "_ids", F.col("_newest.qid")
    )
    columns = []
    for qid in schema.question_ids:
        entry = last_with_key(F.col("_newest"), F.col("_ids"), qid)
        columns.append(F.coalesce(entry["descr"], F.lit("")).alias(qid))
        columns.append(entry["score"].alias(qid + fv.SCORE_SUFFIX))
    return newest.select(*keys, *columns, F.col("total_score").alias(fv.TOTAL_SCORE))


def extraction_wide(parsed: DataFrame, schema: ReviewSchema, *keys: str) -> DataFrame:
    """``keys, field*``; of a repeated field the last counts, an absent one is empty."""
    newest = parsed.withColumn("_newest", F.reverse("de_items")).withColumn(
        "_keys", F.col("_newest.key")
    )
    columns = [
        F.coalesce(
            last_with_key(F.col("_newest"), F.col("_keys"), key)["value"], F.lit("")
        ).alias(key)
        for key in schema.field_keys
    ]
    return newest.select(*keys, *columns)
