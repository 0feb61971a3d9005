"""Segments of lines and how they are packed; the state of a fold holds sizes only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str) -> Window:
    return Window.partitionBy(key).orderBy("n")


def segments(rows: DataFrame, key: str, cut: Column) -> DataFrame:
    """key, start and end (exclusive): a segment begins at the first line and at each cut."""
    cuts = rows.withColumn("last", F.max("n").over(Window.partitionBy(key))).filter(cut | (F.col("n") == 1))
    return cuts.select(key, F.col("n").alias("start"), F.coalesce(F.lead("n").over(_by(key)), F.col("last") + 1).alias("end"))


def sized_segments(rows: DataFrame, key: str, cut: Column) -> DataFrame:
    """key, segment number from 1, its lines and its size."""
    number = F.sum(F.when(cut | (F.col("n") == 1), 1).otherwise(0)).over(_by(key))
    return rows.withColumn("k", number).groupBy(key, "k").agg(F.min("n").alias("s"), F.max("n").alias("e"), F.sum(F.length("line") + 1).alias("size"))


def chunk_starts(sizes: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) of the items that begin a chunk, by one fold; ``fits(used, size)`` says whether an item still goes in.

    The array grows with the chunks, not with the items.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, size: Column) -> Column:
        goes = (a["at"] > 0) & fits(a["used"], size)
        starts = F.when(goes, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["at"])))
        return F.struct(F.when(goes, a["used"] + size).otherwise(size).alias("used"), (a["at"] + 1).alias("at"), starts.alias("starts"))

    return F.aggregate(sizes, zero, step)["starts"]


def _laid_out(held: DataFrame, key: str, fits: Callable[[Column, Column], Column]) -> DataFrame:
    """key, chunk (from 1) and the items of each chunk, from the ordered ``items`` (with size) of each key."""
    cut = held.withColumn("starts", chunk_starts(F.transform("items", lambda x: x["size"]), fits))
    bounds = F.transform("starts", lambda s, i: F.struct((i + 1).cast("bigint").alias("chunk"), s.alias("s"), F.coalesce(F.get("starts", i + 1), F.size("items")).alias("e")))
    each = cut.select(key, "items", F.explode(bounds).alias("b"))
    return each.select(key, "b.chunk", F.slice("items", F.col("b.s") + 1, F.col("b.e") - F.col("b.s")).alias("items"))


def greedy(rows: DataFrame, key: str, size: str, cap: int) -> DataFrame:
    """Lines to chunks of at most ``cap`` (a longer line is a chunk of its own): key, chunk, line_start, line_end."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("n", F.col(size).cast("bigint").alias("size")))).alias("items"))
    cut = _laid_out(held, key, lambda used, s: used + s <= cap)
    return cut.select(key, "chunk", F.get("items", 0)["n"].alias("line_start"), F.element_at("items", -1)["n"].alias("line_end"))


def pack_segments(parts: DataFrame, key: str, target: int, cap: int) -> DataFrame:
    """A segment joins the chunk before while that is under the target and both fit the cap."""
    held = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("k", "s", "e", F.col("size").cast("bigint").alias("size")))).alias("items"))
    cut = _laid_out(held, key, lambda used, s: (used < target) & (used + s <= cap))
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x["size"])
    return cut.select(key, "chunk", F.get("items", 0)["s"].alias("line_start"), F.element_at("items", -1)["e"].alias("line_end"), total.alias("size"))


def trim_edges(rows: DataFrame, key: str, chunk: str) -> DataFrame:
    """First and last line of each chunk that is not blank; blank chunks are left out."""
    full = F.when(F.trim("line") != "", F.col("n"))
    return rows.groupBy(key, chunk).agg(F.min(full).alias("line_start"), F.max(full).alias("line_end")).filter("line_start is not null")


def common_conditions(rows: DataFrame, key: str, order: str, conditions: str) -> DataFrame:
    """Conditions that all lines of a chunk share, in the order of its first line."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("n"), F.col(conditions).alias("c")))).alias("items"))
    first = F.get("items", 0)["c"]
    return held.select(key, F.aggregate("items", first, lambda a, x: F.filter(a, lambda c: F.array_contains(x["c"], c))).alias("common"))


def section_sizes(rows: DataFrame, key: str, head: Column) -> DataFrame:
    """Characters (with line ends) of each section; what stands before the first head is section 0."""
    number = F.sum(head.cast("int")).over(_by(key))
    return rows.withColumn("section", number).groupBy(key, "section").agg(F.sum(F.length("line") + 1).alias("chars"))
