"""Column functions over long arrays whose cost stays far from the square of their length.

A lambda's body is evaluated anew for each element, and what is appended to an array is copied with all before
it. So values are bound first, and arrays are walked through in about sqrt(n) chunks of sqrt(n) elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bind import let


def chunks(items: Column) -> Column:
    """An array's elements in order, in about as many arrays as each has elements."""

    def cut(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.size(x) - 1, step), lambda i: F.slice(x, i + 1, step))).otherwise(F.slice(F.array(x), 1, 0))

    return let(items, cut)


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
    """What ``step`` puts out for each element: from the state and an element it makes a struct of ``state`` and ``out``."""
    none = f"cast(array() as array<{out_type}>)"

    def over_chunk(acc: Column, chunk: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), F.expr(none).alias("out"))
        inner = F.aggregate(chunk, begin, lambda a, x: let(step(a["state"], x), lambda s: F.struct(s["state"].alias("state"), F.concat(a["out"], F.array(s["out"])).alias("out"))))
        return let(inner, lambda v: F.struct(v["state"].alias("state"), F.concat(acc["out"], F.array(v["out"])).alias("out")))

    begin = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{out_type}>>)").alias("out"))
    return F.aggregate(chunks(items), begin, over_chunk, lambda acc: F.flatten(acc["out"]))


def indexed(spans: Column) -> Column:
    """Chunks of spans (structs with start and finish, sorted by start), with the least and the last start and the
    largest finish of each, for ``overlaps`` and ``next_start``."""

    def summary(c: Column) -> Column:
        places = F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["finish"].alias("finish")))
        return F.struct(c[0]["start"].alias("low"), F.element_at(c, -1)["start"].alias("last"), F.array_max(F.transform(c, lambda s: s["finish"])).alias("high"), places.alias("items"))

    return F.transform(chunks(spans), summary)


def overlaps(index: Column, start: Column, finish: Column) -> Column:
    """Does any span share a place with the one from ``start`` to ``finish``?"""
    return F.exists(index, lambda c: F.when((c["low"] < finish) & (start < c["high"]), F.exists(c["items"], lambda s: (s["start"] < finish) & (start < s["finish"]))).otherwise(F.lit(False)))


def next_start(index: Column, start: Column) -> Column:
    """The least start beyond this one, or null."""
    within = lambda c: F.array_min(F.transform(F.filter(c["items"], lambda s: s["start"] > start), lambda s: s["start"]))
    return F.array_min(F.transform(index, lambda c: F.when(c["low"] > start, c["low"]).when(c["last"] > start, within(c))))
