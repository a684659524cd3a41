"""Values computed once and folds over arrays, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: what a lambda names again is evaluated again."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


CHUNK = 64  # items whose results are gathered at a time: appending to one array would copy it for every item


def folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """An array with what ``step`` gives for each item, while it hands a state on. ``step`` returns (result, state)."""
    return bound(items, lambda own: _folded(own, state, step))


def _folded(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    none = F.filter(F.array(step(state, F.get(items, F.lit(0)))[0]), lambda _: F.lit(False))

    def one(acc: Column, item: Column) -> Column:
        result, after = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def chunk(acc: Column, at: Column) -> Column:
        own = F.aggregate(F.slice(items, at * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return bound(own, lambda own: F.struct(own["state"].alias("state"), F.concat(acc["out"], F.array(own["out"])).alias("out")))

    chunks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    begin = F.struct(state.alias("state"), F.filter(F.array(none), lambda _: F.lit(False)).alias("out"))
    return F.when(F.size(items) == 0, none).otherwise(F.flatten(F.aggregate(chunks, begin, chunk)["out"]))
