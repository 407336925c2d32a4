"""Texts that a reply holds, kept as places in it, so that a table need not hold them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersieve.functions.arrays import bound

LEAST_CHARS = 64
"""Shorter texts are kept as they are."""
MOST_ITEMS = 256
"""Of a reply with more items each keeps its text, since finding one takes a walk from the beginning of the reply."""


def stored_item(item: T.StructType) -> T.StructType:
    """What ``to_places`` makes of an item."""
    return T.StructType([*item.fields, T.StructField("at", T.IntegerType()), T.StructField("chars", T.IntegerType())])


def _plain(response: Column) -> Column:
    """A reply as its answers show it, without quotation marks."""
    mark = F.lit('"')
    return F.when(F.contains(response, mark), F.replace(response, mark, F.lit(""))).otherwise(response)


def to_places(items: Column, item: T.StructType, text: str, response: Column) -> Column:
    """``items`` with ``at`` and ``chars``, and no ``text`` where these tell it.

    A long text that stands in ``response``, quotation marks aside, behind that of the item before, is told by its
    first character there, from 1, and its length. Any other is kept, so ``from_places`` gives back every item as it was.
    """
    kind = stored_item(item).simpleString()

    def stored(old: Column, at: Column) -> Column:
        columns = [F.when(at.isNull(), old[text]) if name == text else old[name] for name in item.names]
        chars = F.when(at.isNotNull(), F.length(old[text]))
        return F.when(old.isNotNull(), F.struct(*columns, at, chars)).cast(kind)

    def place(plain: Column, old: Column, behind: Column) -> Column:
        # half a character could not be told by a count of characters
        fit = (F.length(old[text]) >= LEAST_CHARS) & F.is_valid_utf8(old[text])
        at = F.when(fit, F.position(old[text], plain, behind))
        return F.when(at > 0, at)

    def one_more(plain: Column, held: Column, old: Column) -> Column:
        return bound(
            place(plain, old, held["behind"]),
            lambda at: F.struct(
                F.coalesce(at + F.length(old[text]), held["behind"]).alias("behind"),
                F.concat(held["items"], F.array(stored(old, at))).alias("items"),
            ),
        )

    def placed(plain: Column) -> Column:
        start = F.struct(F.lit(1).alias("behind"), F.array().cast(f"array<{kind}>").alias("items"))
        return F.aggregate(items, start, lambda held, old: one_more(plain, held, old), lambda held: held["items"])

    nowhere = F.transform(items, lambda old: stored(old, F.lit(None).cast("int")))
    return F.when(F.size(items) <= MOST_ITEMS, bound(_plain(response), placed)).otherwise(nowhere)


def from_places(items: Column, item: T.StructType, text: str, response: Column) -> Column:
    """What ``to_places`` was given. Items without places are taken as they are."""
    def whole(stored: Column, plain: Column) -> Column:
        told = F.when(stored["at"].isNull(), stored[text]).otherwise(F.substr(plain, stored["at"], stored["chars"]))
        columns = [(told if name == text else stored[name]).alias(name) for name in item.names]
        return F.when(stored.isNotNull(), F.struct(*columns))

    return bound(_plain(response), lambda plain: F.transform(items, lambda stored: whole(stored, plain)))
