"""Spark expressions over long arrays: values computed once, and folds in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items folded at a time; what they put out is copied once a block.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and in whatever lambda it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def gathered(items: Column, start: dict[str, Column], step, kind: str) -> Column:
    """Fold the items in order and gather what they put out: one array of ``kind``.

    ``step(state, item)`` gives the next state, a dict like ``start``, and an array to put out. Arrays
    cannot grow in place, so items are folded in blocks, whose outputs are joined at the end.
    """

    def struct(fields: dict[str, Column], out: Column) -> Column:
        return F.struct(*[fields[n].alias(n) for n in start], out.alias("out"))

    def state(acc: Column) -> dict[str, Column]:
        return {n: acc[n] for n in start}

    def inner(acc: Column, item: Column) -> Column:
        fields, put = step(state(acc), item)
        return struct(fields, F.concat(acc["out"], put))

    def outer(acc: Column, block: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        done = F.aggregate(block, struct(state(acc), none), inner)
        return bound(done, lambda d: struct(state(d), F.concat(acc["out"], F.array(d["out"]))))

    def run(all_items: Column) -> Column:
        last = F.greatest(F.ceil(F.size(all_items) / BLOCK).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK)))
        none = F.array().cast(f"array<array<{kind}>>")
        return F.aggregate(blocks, struct(start, none), outer, lambda acc: F.flatten(acc["out"]))

    return bound(items, run)
