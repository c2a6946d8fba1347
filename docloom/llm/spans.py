"""Spans of regular expressions as Column expressions: code points, no Python on the executors.

Spark has no function that gives the places of all matches. The text parted by the expression
gives the lengths of the gaps, the extracted matches their own lengths; running sums of both give
the places. Sums run in blocks, so that a text with k matches costs about k * BLOCK steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
SPAN = "array<struct<begin:int,rank:int,end:int,kind:string,match:string,group:string>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Sums of the first i numbers, for each i from 1."""

    def offsets(xs: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
        return F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))

    def sums(xs: Column) -> Column:
        return let(offsets(xs), lambda offs: F.transform(xs, lambda _, i: F.get(offs, F.floor(i / BLOCK).cast("int")) + total(F.slice(xs, (F.floor(i / BLOCK) * BLOCK).cast("int") + 1, i % BLOCK + 1))))

    return let(numbers, sums)


def spans(text: Column, pattern: str, kind: str, rank: int, valid: Callable[[Column, Column], Column], maybe: Column | None = None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches that are valid(match, group), in order, as SPAN.

    maybe: a cheap condition without which the text cannot hold a match.
    """
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        steps = F.transform(found, lambda _, i: F.struct(i.alias("i")))  # one for each match
        own = F.transform(found, F.length)

        def build(gap: Column) -> Column:
            def built(size: Column) -> Column:
                lengths = F.transform(steps, lambda s: F.get(gap, s["i"]) + F.when(s["i"] > 0, F.get(size, s["i"] - 1)).otherwise(0))
                rows = F.transform(
                    F.arrays_zip(running(lengths).alias("begin"), size.alias("size"), found.alias("match"), groups.alias("group")),
                    lambda r: F.struct(r["begin"].alias("begin"), F.lit(rank).alias("rank"), (r["begin"] + r["size"]).alias("end"), F.lit(kind).alias("kind"), r["match"].alias("match"), r["group"].alias("group")),
                )
                return F.filter(rows, lambda r: valid(r["match"], r["group"]))

            return let(own, built)

        return let(gaps, build).cast(SPAN)

    every = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))
    return every if maybe is None else F.when(maybe, every).otherwise(none)


def listed(found: Column) -> Column:
    """kind:begin:end of the spans by begin, then rank, parted by commas."""
    return F.array_join(F.transform(F.sort_array(found), lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def overlapping(a: Column, b: Column) -> Column:
    return (a["begin"] < b["end"]) & (b["begin"] < a["end"])
