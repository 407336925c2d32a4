"""Column helpers for text: stripping, shortening, file names, numbers, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papersieve import fixed_values as fv


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends (``trim`` removes only blanks)."""
    return F.btrim(text, F.lit(fv.SPACES))


def _shorten(text: Column, limit: int, notice: str) -> Column:
    short = F.concat(F.substring(text, 1, limit), F.lit(notice))
    return F.when(F.length(text) > limit, short).otherwise(text)


def preview(text: Column, limit: int = fv.PREVIEW_CHARS) -> Column:
    """The opening of a text, with a notice where something was left out."""
    return _shorten(text, limit, fv.PREVIEW_NOTICE)


def truncate(text: Column, limit: int | None) -> Column:
    """Text cut to ``limit`` characters plus a notice; no limit when it is None or 0."""
    return _shorten(text, limit, fv.TRUNCATION_NOTICE) if limit else text


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; leading dots belong to the stem."""
    return F.regexp_replace(file_name(path), r"(?s)^(\.*+[^.].*)\.[^.]*\z", "$1")


def number(text: Column) -> Column:
    """Text as a double, or NULL; stricter than a cast, which takes ``1.0f``."""
    clean = strip(text)
    return (
        F.when(clean.rlike(fv.NUMBER), F.replace(clean, F.lit("_"), F.lit("")).try_cast("double"))
        .when(clean.rlike(fv.INFINITY), clean.try_cast("double"))
        .when(clean.rlike(fv.NOT_A_NUMBER), F.lit(float("nan")))
    )


def section(text: Column, start: str, end: str) -> Column:
    """Stripped text between the first ``start`` and the next ``end``, else NULL.

    Plain string functions do this several times faster than a lazy pattern.
    """
    rest = F.get(F.split(text, start, 2), F.lit(1))
    # Unchanged by the cut means that the end marker is missing.
    return strip(F.nullif(F.substring_index(rest, end, 1), rest))


def last_with_key(newest_first: Column, keys: Column, key: str) -> Column:
    """The entry for ``key`` in an array given in reverse, NULL when absent."""
    return F.get(newest_first, (F.array_position(keys, key) - 1).cast("int"))
