"""Regular-expression matches with their code-point positions, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches (never empty ones) as strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches that are placed together: appending to an array copies it, so long lists are built of short ones.
BLOCK = 256


def located(text: Column, found: Column, pattern: str) -> Column:
    """start, end (exclusive) and value of each of `found`, matches() of the pattern.

    What lies between the matches is what split() leaves; running lengths give the positions. The text is split once, and
    the work grows with its length and its matches. Texts without a match, nearly all, stop at the size test."""
    empty = F.array().cast(SPAN)

    def step(x: Column) -> Callable[[Column, Column], Column]:
        def one(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["gaps"], i))
            spans = lambda s: let(
                s + F.length(F.get(x["found"], i)),
                lambda e: F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(s.alias("start"), e.alias("end"), F.get(x["found"], i).alias("value"))).alias("out")),
            )
            return let(start, spans)

        return one

    def walked(x: Column) -> Column:
        last = F.size(x["found"]) - 1

        def block(acc: Column, b: Column) -> Column:
            within = F.aggregate(F.sequence(b * BLOCK, F.least(last, (b + 1) * BLOCK - 1)), F.struct(acc["at"].alias("at"), empty.alias("out")), step(x))
            return let(within, lambda w: F.struct(w["at"].alias("at"), F.array_append(acc["out"], w["out"]).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), (last / BLOCK).cast("int")), start, block, lambda acc: F.flatten(acc["out"]))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"))
    return F.when(F.size(found) > 0, let(parts, walked)).otherwise(empty)
