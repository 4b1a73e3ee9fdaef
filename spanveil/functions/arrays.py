"""Small helpers around array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
PAGE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer inlines an alias that is referenced once, even if that one
    reference sits in a lambda that runs per element; a lambda variable cannot
    be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(array: Column) -> Column:
    """0, 1, ... for each element; empty for an empty array."""
    return F.transform(array, lambda _, i: i)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """What all earlier elements combine to, for each element of ``array<int>``.

    ``F.aggregate`` copies its accumulator at every step, so gathering a list
    in it is quadratic.  Lists are gathered here for one block at a time only;
    between blocks just one number per block is combined.
    """
    start = F.lit(zero)

    def before_each(block: Column, before: Column) -> Column:
        return F.aggregate(
            F.slice(block, 1, F.size(block) - 1),
            F.array(before),
            lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))),
        )

    def over_blocks(blocks: Column, totals: Column) -> Column:
        return F.flatten(
            F.transform(
                blocks,
                lambda block, j: let(
                    F.aggregate(F.slice(totals, F.lit(1), j), start, combine),
                    lambda before: before_each(block, before),
                ),
            )
        )

    def in_blocks(array: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")),
            lambda j: F.slice(array, j * BLOCK + 1, F.lit(BLOCK)),
        )
        return let(
            blocks,
            lambda bs: let(
                F.transform(bs, lambda block: F.aggregate(block, start, combine)),
                lambda totals: over_blocks(bs, totals),
            ),
        )

    def any_size(array: Column) -> Column:
        n = F.size(array)
        return (
            F.when(n == 0, F.array().cast("array<int>"))
            .when(n <= BLOCK, before_each(array, start))
            .otherwise(in_blocks(array))
        )

    return let(values, any_size)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def running_max(values: Column) -> Column:
    """-1 before the first element."""
    return running(values, lambda a, b: F.greatest(a, b), -1)


def pages_of(text: Column) -> Column:
    """Cut a text into pages of equal length for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def cut(pages: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)``; touches only the pages that hold them.

    A plain ``substring`` walks the whole UTF-8 text on each call, which is
    quadratic for a long document with many spans.
    """
    first = F.floor(start / PAGE).cast("int")
    last = F.floor((end - 1) / PAGE).cast("int")
    return F.when(
        end > start,
        F.array_join(F.slice(pages, first + 1, last - first + 1), "").substr(
            start - first * PAGE + 1, end - start
        ),
    ).otherwise("")
