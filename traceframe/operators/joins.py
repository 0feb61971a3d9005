"""Joins that need more than one equality: intervals, as-of, nearest, division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, bin_width: int | None = None) -> DataFrame:
    """Points with the spans of the same key that hold them (both ends included).

    The key keeps it a hash or merge join.  Where one key has very many rows, ``bin_width``
    cuts the axis: a span is repeated for each bin that it touches and the bin joins the key.
    """
    if bin_width is None:
        return points.join(spans, key).filter(F.col(point).between(F.col(start), F.col(end)))
    at = points.withColumn("_bin", F.floor(F.col(point) / bin_width))
    over = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width))))
    return at.join(over, [key, "_bin"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_bin")


def first_span(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, order: Column, value: str, by: list[str]) -> DataFrame:
    """Each point (named by ``by``) with the value of the first span that holds it; points without one are left out."""
    hit = interval_join(points, spans, key, point, start, end)
    return hit.groupBy(*by).agg(F.min_by(F.col(value), order).alias(value))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, strict: bool = True) -> DataFrame:
    """``left`` with ``value`` of the latest row of ``right`` with the same key before it (or at it, if not strict).

    Both sides are laid on one line and the last value is carried forward, so the cost is
    one sort by key and time whatever the number of rows between.
    """
    a = left.withColumn("_side", F.lit(0 if strict else 1)).withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(key, time, F.col(value).alias("_value")).withColumn("_side", F.lit(1 if strict else 0))
    line = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"last_{value}", F.last("_value", ignorenulls=True).over(line))
    return both.filter(F.col("_side") == (0 if strict else 1)).drop("_side", "_value")


def division(rows: DataFrame, by: str, item: str, wanted: DataFrame) -> DataFrame:
    """Values of ``by`` that go with every item of ``wanted`` (one column of the same name)."""
    need = wanted.select(item).distinct()
    have = rows.select(by, item).distinct().join(need, item, "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return have.join(need.agg(F.count(F.lit(1)).alias("n")), "n").select(by)


def full_outer_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (gone, new, changed) and the names of the changed columns."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("a"))
    b = new.select(*keys, F.struct(*rest).alias("b"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in rest]))
    kind = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(F.size("changed") > 0, "changed")
    joined = a.join(b, keys, "full_outer").withColumn("changed", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    return joined.select(*keys, kind.alias("kind"), "changed").filter("kind is not null")
