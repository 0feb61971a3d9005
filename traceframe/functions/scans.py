"""Running values over arrays, in time linear in their length.

Appending to an array copies it, so a plain fold that keeps every step is quadratic.
Here the array is cut in blocks; each is folded by itself, the totals of the blocks are
folded, and both are put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block.
BLOCK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _folded(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array(zero), lambda done, x: F.concat(done, F.array(add(F.element_at(done, -1), x))))


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each place of ``values`` what ``add`` makes of all before it, and of all at the end: one value more.

    ``add`` has to be associative, with ``zero`` as its neutral element.
    """

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v) + 1, F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: _folded(F.slice(v, at, F.lit(BLOCK)), zero, add))
        return let(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.element_at(b, -1))
        return let(_folded(totals, zero, add), lambda before: F.concat(F.flatten(_shifted(blocks, before, add)), F.slice(before, -1, 1)))

    return let(values, whole)


def _shifted(blocks: Column, before: Column, add: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, start: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: add(start, x)))
