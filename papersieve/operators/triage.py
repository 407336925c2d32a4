"""Deciding documents: title, exclusion, cutoff, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions.arrays import bound
from papersieve.functions.text import file_stem, last_with_key
from papersieve.operators.parsing import computed_once
from papersieve.schema import ReviewSchema


def resolve_title(newest_fields: Column, keys: Column, name: Column) -> Column:
    """The title field under its first spelling that occurs, else the file stem.

    Occurrence decides: an empty ``TITLE`` hides a filled ``Title``.
    """
    found = F.coalesce(
        *[last_with_key(newest_fields, keys, key)["value"] for key in fv.TITLE_KEYS]
    )
    return F.coalesce(F.nullif(found, F.lit("")), file_stem(name))


def excluded_by(newest_items: Column, ids: Column, excluding: tuple[str, ...]) -> Column:
    """The first excluding question whose last score is 0; a missing score is not 0."""
    hits = [
        F.when(last_with_key(newest_items, ids, qid)["score"] == 0, F.lit(qid))
        for qid in excluding
    ]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def excluded_by_any(newest_items: Column, ids: Column, excluding: Column) -> Column:
    """``excluded_by`` where the excluding questions are a column, an array of ids in their order.

    Items and ids are fixed first, or they would be made again for each excluding question.
    """
    def first(newest: Column) -> Column:
        def hit(qid: Column) -> Column:
            place = (F.array_position(newest["ids"], qid) - 1).cast("int")
            return F.coalesce(F.get(newest["items"], place)["score"] == 0, F.lit(False))

        return F.get(F.filter(excluding, hit), F.lit(0))

    return bound(F.struct(newest_items.alias("items"), ids.alias("ids")), first)


def excluded_by_join(quality_items: DataFrame, excluding: DataFrame, key: str) -> DataFrame:
    """The same as a set operation over long items: ``key, excluded_by``.

    ``excluding`` is the schema's table, a few rows by nature.
    """
    last = quality_items.groupBy(key, "qid").agg(F.max_by("score", "ord").alias("score"))
    hit = last.join(
        F.broadcast(excluding.select(F.col("id").alias("qid"), F.col("ord").alias("rank"))), "qid"
    ).where(F.col("score") == 0)
    return hit.groupBy(key).agg(F.min_by("qid", "rank").alias("excluded_by"))


def passes_cutoff(total: Column, cutoff: float | Column) -> Column:
    """A zero total never passes, whatever the cutoff; NaN sorts high, so it is named."""
    least = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    return (total != 0) & ~F.isnan(total) & (total >= least)


def triage(parsed: DataFrame, schema: ReviewSchema) -> DataFrame:
    """Adds ``title, has_title, excluded_by, passes_cutoff, status, reason``.

    Takes the output of both parsers with ``file_name``, ``has_text`` and
    ``response``. Exclusion is tested before the cutoff.
    """
    return decided_by(
        parsed,
        lambda items, ids: excluded_by(items, ids, schema.excluding),
        lambda total: passes_cutoff(total, schema.cutoff),
    )


def decided_by(
    parsed: DataFrame,
    excluded: Callable[[Column, Column], Column],
    passes: Callable[[Column], Column],
) -> DataFrame:
    """``triage`` by any rules: ``excluded`` of the newest items and their ids, ``passes`` of the total."""
    answered = F.coalesce(F.col("response") != "", F.lit(False))
    is_excluded = F.col("excluded_by").isNotNull()
    status = (
        F.when(~F.col("has_text"), fv.NO_TEXT)
        .when(~answered, fv.NO_RESPONSE)
        .when(F.col("qa_failed"), fv.PARSE_ERROR)
        .when(~is_excluded & F.col("passes_cutoff"), fv.ANALYSED)
        .otherwise(fv.REJECTED)
    )
    reason = F.when(
        F.col("status") == fv.REJECTED, F.when(is_excluded, fv.EXCLUDED).otherwise(fv.CUTOFF)
    )
    decided = (
        parsed.withColumns({"_items": F.reverse("qa_items"), "_fields": F.reverse("de_items")})
        .withColumns({"_ids": F.col("_items.qid"), "_keys": F.col("_fields.key")})
        .withColumns({
            "title": F.when(
                answered, resolve_title(F.col("_fields"), F.col("_keys"), F.col("file_name"))
            ),
            "has_title": F.coalesce(F.array_contains("_keys", fv.TITLE), F.lit(False)),
            "excluded_by": excluded(F.col("_items"), F.col("_ids")),
            "passes_cutoff": F.coalesce(passes(F.col("total_score")), F.lit(False)),
        })
        .withColumn("status", status)
        .withColumn("reason", reason)
        .drop("_items", "_fields", "_ids", "_keys")
    )
    return computed_once(
        decided, "title", "has_title", "excluded_by", "passes_cutoff", "status", "reason"
    )
