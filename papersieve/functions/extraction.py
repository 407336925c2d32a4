"""Column expressions that read extraction fields out of a reply.

A field is ``STRUCT<key, value>``; fields keep the order of the reply.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from papersieve import fixed_values as fv
from papersieve.functions.text import section, strip

FIELD_TYPE = "array<struct<key:string,value:string>>"


def de_section(response: Column) -> Column:
    return section(response, fv.DE_START, fv.DE_END)


def _after_colon(text: Column) -> Column:
    return F.substr(text, F.position(F.lit(":"), text) + 1)


def marked_matches(text: Column) -> Column:
    """Spans from an upper-case key to the next such key or the end."""
    return F.regexp_extract_all(text, F.lit(fv.FIELD), F.lit(0))


def strict_matches(text: Column, keys: list[str]) -> Column:
    """Spans from one of ``keys`` to the next of them or the end; other capitals belong to the value."""
    key = f"(?:{'|'.join(map(re.escape, keys))}):" if keys else r"(?!)"
    pattern = rf"(?s)(?<!(?!{fv.SPACE}).){key}.*?(?={fv.SPACE}{key}|\z)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def marked_fields(matches: Column) -> Column:
    return F.transform(
        matches,
        lambda span: F.struct(
            strip(F.substring_index(span, ":", 1)).alias("key"),
            strip(_after_colon(span)).alias("value"),
        ),
    )


def title_found(text: Column) -> Column:
    return text.rlike(fv.LOOSE_TITLE)


def title_field(text: Column) -> Column:
    """The single field rescued from a section that holds no other key."""
    title = strip(F.regexp_extract(text, fv.LOOSE_TITLE, 1))
    return F.array(F.struct(F.lit(fv.TITLE).alias("key"), title.alias("value")))


def unmarked_fields(response: Column) -> Column:
    """``key: value`` lines below the heading of a reply without markers."""
    below = F.get(F.split(response, fv.DE_HEADING, 2), F.lit(1))
    part = strip(F.get(F.split(below, fv.DE_STOPS, 2), F.lit(0)))
    pairs = F.transform(
        F.filter(F.split(part, "\n", -1), lambda line: F.contains(line, F.lit(":"))),
        lambda line: F.struct(
            strip(F.translate(F.substring_index(line, ":", 1), '"*', "")).alias("key"),
            strip(F.replace(_after_colon(line), F.lit('"'), F.lit(""))).alias("value"),
        ),
    )
    named = F.filter(pairs, lambda pair: pair["key"] != "")
    return F.coalesce(named, no_fields())


def no_fields() -> Column:
    return F.array().cast(FIELD_TYPE)
