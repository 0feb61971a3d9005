"""Graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge.

    Each round hooks every component to the smallest component that it touches and then
    follows the hooks to their ends, so the number of components falls at least by half
    where any are left to join.  Only edges between different components are kept from
    round to round.  Loops and repeated edges do no harm; null ends are ignored.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    live = materialize(ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct()
    label = materialize(nodes.select("node", F.col("node").alias("component")), "labels")
    while not live.isEmpty():
        hook = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        hook = _to_roots(materialize(hook, "hooks"))
        moved = label.join(hook.select(F.col("node").alias("component"), "to"), "component", "left")
        label = materialize(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        for end in ("a", "b"):
            live = live.join(hook.select(F.col("node").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        between = live.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = materialize(between, "edges")
    return label


def _to_roots(hook: DataFrame) -> DataFrame:
    """Replace each target by the end of its chain; targets are smaller, so chains end."""
    while True:
        ahead = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        longer = materialize(hook.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
        hook = longer.select("node", "to")
        if longer.filter("moved").isEmpty():
            return hook
