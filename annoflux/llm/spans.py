"""Places of regular-expression matches in a text, by built-in functions only.

Spark returns matches without their places. A match starts where the texts
between the matches and the matches before it end, so places come from summing
the lengths of ``split`` and ``regexp_extract_all`` over the same pattern.
Offsets are in code points, end exclusive. Work is about linear in the matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Items that one fold copies again and again; longer arrays are folded chunk by chunk.
CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas use it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(items: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array of non-negative integers, the joined items before it (0 for the first)."""

    def fold(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(chunk, start, lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")))

    last = lambda p: F.greatest(F.floor((F.size(p) - 1) / CHUNK).cast("int"), F.lit(0))
    chunks = let(items, lambda p: F.transform(F.sequence(F.lit(0), last(p)), lambda i: fold(F.slice(p, i * CHUNK + 1, F.lit(CHUNK)))))
    shifted = lambda f, starts: F.flatten(F.zip_with(f, starts, lambda x, s: F.transform(x["before"], lambda b: join(s, b))))
    return let(chunks, lambda f: shifted(f, fold(F.transform(f, lambda x: x["at"]))["before"]))


def find(text: Column, pattern: str | Column, might: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of a pattern that never matches the empty string.

    ``might``: a cheap test that is true of every text with a match.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))  # lit leaves columns as they are
    between = F.split(text, pattern, -1)
    # a match's gap and value are struct fields; the last gap has no match
    pairs = F.zip_with(values, between, lambda v, g: F.struct(F.length(g).alias("gap"), v.alias("value")))

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: x["gap"] + F.length(x["value"])), lambda a, x: a + x)
        at = lambda x, b: x["gap"] + b
        return F.zip_with(p, before, lambda x, b: F.struct(at(x, b).alias("start"), (at(x, b) + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    test = F.rlike(text, F.lit(pattern)) if might is None else might & F.rlike(text, F.lit(pattern))
    return F.when(test, let(F.filter(pairs, lambda x: x["value"].isNotNull()), placed)).otherwise(F.array().cast(SPAN))


def blanked(text: Column, pattern: str, might: Column) -> Column:
    """The text with spaces in place of every match, as many as its characters."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), values, lambda g, v: F.concat(g, F.repeat(F.lit(" "), F.coalesce(F.length(v), F.lit(0)))))
    return F.when(might, F.array_join(parts, "")).otherwise(text)


def replaced(text: Column, spans: Column) -> Column:
    """The text with what each span covers replaced by its ``put``; ``spans`` (start, end, put) are in order.

    Of spans that overlap, the first one's replacement stands for all that they cover.
    """

    def rebuild(chars: Column, spans: Column) -> Column:
        reached = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        clear = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")
        parts = F.zip_with(spans, reached, lambda s, a: F.when(s["start"] >= a, F.concat(clear(a, s["start"] - a), s["put"])).otherwise(""))
        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), clear(end, F.greatest(F.size(chars) - end, F.lit(0))))

    whole = let(spans, lambda s: let(F.split(text, ""), lambda c: rebuild(c, s)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            places,
            lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2).cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0
