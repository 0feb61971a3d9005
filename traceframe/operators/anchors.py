"""Anchors: facts that a snapshot has to hold, tested after it was built (T30).

An anchor counts the rows of a table for which a predicate holds, and expects from
``least`` to ``most`` of them.  All anchors of a table are one aggregate over it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Anchor(NamedTuple):
    rule: str
    table: str
    predicate: str
    least: int = 1
    most: int | None = None


def check(spark: SparkSession, read: Callable[[str], DataFrame], anchors: list[Anchor]) -> DataFrame:
    """rule, table, found and fine of every anchor; a predicate that is null for a row does not hold there.

    ``read`` gives a table by its name, as ``Engine.table`` does.
    """
    parts = []
    for name in sorted({a.table for a in anchors}):
        own = [a for a in anchors if a.table == name]
        fine = lambda a, n: (n >= a.least) & (F.lit(True) if a.most is None else n <= a.most)
        counted = read(name).agg(*[F.count_if(F.expr(a.predicate)).alias(f"n{i}") for i, a in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(a.rule).alias("rule"), F.lit(name).alias("table"), F.col(f"n{i}").alias("found"), fine(a, F.col(f"n{i}")).alias("fine")) for i, a in enumerate(own)])
        parts.append(counted.select(F.explode(rows).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "rule string, table string, found bigint, fine boolean")
