"""Match positions as native expressions: Spark has functions for the matches of a pattern but none for where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths are summed up in chunks of so many (a power of two), so that a place costs a chunk's sum and not that of all before it.
_BITS = 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def sums_before(widths: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that gives the sum of the first i values of an array of int that isn't empty."""
    size = 1 << _BITS

    def with_chunks(chunks: Column, w: Column) -> Column:
        starts = F.transform(chunks, lambda _, c: _sum(F.slice(chunks, F.lit(1), c)))
        return let(starts, lambda at: body(lambda i: F.get(at, F.shiftright(i, _BITS)) + _sum(F.slice(w, F.shiftleft(F.shiftright(i, _BITS), _BITS) + 1, i.bitwiseAND(size - 1)))))

    def within(w: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(w) - 1, _BITS)), lambda c: _sum(F.slice(w, F.shiftleft(c, _BITS) + 1, F.lit(size))))
        return let(chunks, lambda c: with_chunks(c, w))

    return let(widths, within)


def find_spans(text: Column, pattern: Column | str, shift: Column | int = 0) -> Column:
    """``array<struct<s int, e int, value string>>`` of the leftmost non-overlapping matches of a pattern (a row's own, if it is
    a column) that never matches nothing; positions are code points, the end exclusive, moved by ``shift``.

    The text between the matches (``split``) and the matches (``regexp_extract_all``) alternate, so sums of their lengths give
    the positions; a text with many matches costs in proportion to them.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    first = (F.lit(shift) if isinstance(shift, int) else shift).cast("int")
    empty = F.array().cast("array<struct<s:int,e:int,value:string>>")

    def spans(between: Column, found: Column) -> Column:
        def placed(before: Callable[[Column], Column]) -> Column:
            def span(m: Column, i: Column) -> Column:
                return let(first + before(i) + F.length(F.get(between, i)), lambda s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("value")))

            return F.transform(found, span)

        return sums_before(F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m)), placed)

    def read(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda between: spans(between, found))).otherwise(empty)

    return F.coalesce(let(F.regexp_extract_all(text, pattern, F.lit(0)), read), empty)
