"""Containment joins over a page's elements: nested intervals (pos, close) in arrays of the row.

Elements come in document order and their intervals are nested, so one fold with a stack of what is open answers both
questions: what an element lies in, and which elements lie in it. Neither looks at all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN, _SEEN, _CLOSED = 1, 0, 2


def _typed(array: Column, kind: str) -> Column:
    return array.cast(f"array<{kind}>")


def nearest(outer: Column, inner: Column, value, kind: str = "string") -> Column:
    """For each of inner, in order, value(o) of the innermost of outer around it and in the same root; null for none.

    outer, inner: arrays of structs with pos, close and root, in document order. kind: the SQL type of the value.
    """
    event = lambda e, k, v: F.struct(e["pos"].alias("at"), F.lit(k).alias("what"), e["close"].alias("close"), e["root"].alias("root"), v.cast(kind).alias("value"))
    events = F.array_sort(F.concat(F.transform(outer, lambda e: event(e, _OPEN, value(e))), F.transform(inner, lambda e: event(e, _SEEN, F.lit(None)))))
    stack = f"struct<at:int,what:int,close:int,root:int,value:{kind}>"
    start = F.struct(_typed(F.array(), stack).alias("open"), _typed(F.array(), f"struct<value:{kind}>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        still = F.filter(acc["open"], lambda o: o["close"] >= e["at"])
        mine = F.filter(still, lambda o: o["root"] == e["root"])
        found = F.struct(F.try_element_at(mine, F.lit(-1))["value"].alias("value"))
        opened = e["what"] == _OPEN
        return F.struct(F.when(opened, F.array_append(still, e)).otherwise(still).alias("open"), F.when(opened, acc["out"]).otherwise(F.array_append(acc["out"], found)).alias("out"))

    return F.transform(F.aggregate(events, start, step)["out"], lambda v: v["value"])


def within(outer: Column, inner: Column) -> Column:
    """Array of (pos, from, n), a row for each of outer: its descendants among inner are slice(inner, from, n).

    An element isn't its own descendant. Rows come in the order in which outer elements close.
    """
    event = lambda e, at, k, tie: F.struct(at.alias("at"), F.lit(k).alias("what"), tie.alias("tie"), e["pos"].alias("pos"))
    events = F.array_sort(
        F.concat(
            F.transform(outer, lambda e: event(e, e["pos"], _OPEN, e["pos"])),
            F.transform(inner, lambda e: event(e, e["pos"], _SEEN, e["pos"])),
            F.transform(outer, lambda e: event(e, e["close"], _CLOSED, -e["pos"])),
        )
    )
    start = F.struct(F.lit(0).alias("n"), _typed(F.array(), "int").alias("open"), _typed(F.array(), "struct<pos:int,from:int,n:int>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        first = F.try_element_at(acc["open"], F.lit(-1))
        row = F.struct(e["pos"].alias("pos"), (first + 1).alias("from"), (acc["n"] - first).alias("n"))
        closed, opened = e["what"] == _CLOSED, e["what"] == _OPEN
        stack = F.when(opened, F.array_append(acc["open"], acc["n"])).when(closed, F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"])
        return F.struct((acc["n"] + F.when(e["what"] == _SEEN, 1).otherwise(0)).alias("n"), stack.alias("open"), F.when(closed, F.array_append(acc["out"], row)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(events, start, step)["out"]
