"""Small helpers over Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as text handling understands it: Unicode's and U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]"
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind.  Only the ends are read."""
    return F.btrim(text, F.lit(_BLANKS))


def filled(text: Column) -> Column:
    """Null for an empty string."""
    return F.when(text != "", text)


def first_filled(*texts: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*(filled(t) for t in texts), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


#: Elements that a running fold goes over at a time, and characters of a piece.
_BLOCK, _PIECE = 256, 4096


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The fold of ``op`` (a sum, a maximum) up to each number of an array, itself
    included.  Blocks are folded by themselves and then carried on, so a long
    array costs its length times a block's and not its square."""

    def fold(xs: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            return F.array_append(acc, F.when(last.isNull(), x).otherwise(op(last, x)))

        return F.aggregate(xs, F.array().cast("array<bigint>"), step)

    def carried(within: Column) -> Column:
        upto = fold(F.transform(within, lambda w: F.try_element_at(w, F.lit(-1))))
        before = F.concat(F.array(F.lit(None).cast("bigint")), upto)
        whole = F.zip_with(within, F.slice(before, 1, F.size(within)), lambda w, c: F.transform(w, lambda x: F.when(c.isNull(), x).otherwise(op(c, x))))
        return F.flatten(whole)

    def blocks(longs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(longs), F.lit(1)), F.lit(_BLOCK))
        return F.transform(starts, lambda k: fold(F.slice(longs, k, _BLOCK)))

    return let(let(values.cast("array<bigint>"), blocks), carried)


def pieces(text: Column) -> Column:
    """A text as an array of pieces, of which :func:`cut` reads the needed ones."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def cut(parts: Column, low: Column, high: Column) -> Column:
    """Characters from ``low`` (counted from 0) up to ``high`` of a text in pieces."""
    first = F.floor(low / _PIECE).cast("int")
    last = F.floor((high - 1) / _PIECE).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(high > low, F.substring(near, (low - first * _PIECE + 1).cast("int"), (high - low).cast("int"))).otherwise(F.lit(""))


def spans(text: Column, pattern: Column) -> Column:
    """array<struct<low, high>> of a pattern's matches: gaps and matches in turn,
    and the running sum of their lengths.  No match may be empty."""

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        sizes = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: g + F.length(m))
        return F.zip_with(running(sizes, lambda a, b: a + b), matches, lambda end, m: F.struct((end - F.length(m)).alias("low"), end.alias("high")))

    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))
