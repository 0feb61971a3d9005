"""Broadcasts behind a check of their size, and partitions of a bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows (of a few fixed-width columns).
BROADCAST_ROWS = 500_000
#: Characters of text, and narrow rows, that a task aggregates or sorts in memory; and the most partitions of a shuffle.
TASK_CHARS, TASK_ROWS, MOST_PARTITIONS = 8_000_000, 1_000_000, 10_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, and unchanged (a shuffled join) if not.

    ``df`` should be a stored table, as its rows are counted.
    """
    return F.broadcast(df) if df.count() <= rows else df


def parts(amount: int | None, each: int = TASK_ROWS) -> int:
    """How many partitions hold ``each`` of ``amount``; given to ``repartition``, the size of a task does not grow with the table."""
    return min(MOST_PARTITIONS, max(1, -(-(amount or 0) // each)))


def characters(columns: list[str]) -> Column:
    """The characters of a row's texts."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)).cast("bigint") for c in columns])
