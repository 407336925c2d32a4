"""Column expressions over arrays that take time in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often and wherever ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(array: Column) -> Column:
    """A bound array in arrays of ``CHUNK`` elements."""
    def chunk(first: Column) -> Column:
        places = F.sequence(first, F.least(first + CHUNK, F.size(array)) - 1)
        return F.transform(places, lambda at: F.get(array, at))

    return F.transform(F.sequence(F.lit(0), F.size(array) - 1, F.lit(CHUNK)), chunk)


def scan(
    array: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    output: Callable[[Column, Column], Column],
    output_type: str,
) -> Column:
    """An array of what ``output`` gives for the state before each element and the element; nulls are left out.

    ``step`` makes the next state of the two. A fold copies what it holds at every
    element, so one that gathered all results would take the square of the time.
    Here a fold over chunks gathers only the state before each chunk, and
    each chunk is then folded on its own from there.
    """
    nothing = F.array().cast(f"array<{output_type}>")

    def states(chunks: Column) -> Column:
        """The state before each chunk."""
        none_yet = F.filter(F.array(start), lambda _: F.lit(False))
        return F.aggregate(
            chunks,
            F.struct(start.alias("now"), none_yet.alias("before")),
            lambda held, chunk: F.struct(
                F.aggregate(chunk, held["now"], step).alias("now"),
                F.concat(held["before"], F.array(held["now"])).alias("before"),
            ),
            lambda held: held["before"],
        )

    def outputs(state: Column, chunk: Column) -> Column:
        def merge(held: Column, element: Column) -> Column:
            new = output(held["state"], element).cast(output_type)
            gathered = F.when(new.isNull(), held["out"]).otherwise(F.concat(held["out"], F.array(new)))
            return F.struct(step(held["state"], element).alias("state"), gathered.alias("out"))

        return F.aggregate(chunk, F.struct(state.alias("state"), nothing.alias("out")), merge, lambda held: held["out"])

    def scanned(elements: Column) -> Column:
        found = bound(_chunks(elements), lambda c: F.flatten(F.zip_with(states(c), c, outputs)))
        # the state before a single chunk is known
        return F.when(F.size(elements) > CHUNK, found).when(F.size(elements) >= 0, outputs(start, elements))

    return bound(array, scanned)
