"""Measuring quality: diffs of snapshots, agreement with a reference, sizes, audit logs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.operators.joins import full_outer_diff
from traceframe.plans.sizing import parts

#: Tasks that rows of one value are dealt to at first, and copies of a row that are made at once.
SALTS, COPIES = 16, 10_000


def meta_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, old and new of the properties that differ (key, value tables)."""
    joined = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full_outer")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new")))


def _collapsed(rows: DataFrame, columns: list[str], values: list[str], how: Callable[[str], Column]) -> DataFrame:
    """One row for each different row of ``columns``, with its values put together by ``how``.

    Rows are dealt out to tasks of a bounded size before they are grouped, as few of them
    are alike; a frequent one goes to several tasks at first.
    """
    n = parts(rows.count())
    put = [how(v).alias(v) for v in values]
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(n, *columns, "_salt")
    once = salted.groupBy(*columns, "_salt").agg(*put)
    return once.drop("_salt").repartition(n, *columns).groupBy(*columns).agg(*put)


def table_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one side has, as multisets, with their side."""
    columns = old.columns
    both = old.withColumn("_n", F.lit(1).cast("bigint")).unionAll(new.withColumn("_n", F.lit(-1).cast("bigint")))
    left = _collapsed(both, columns, ["_n"], F.sum).filter("_n <> 0")
    told = left.select(*columns, F.when(F.col("_n") > 0, "gone").otherwise("new").alias("side"), F.abs("_n").alias("_n"))
    runs = told.select(*columns, "side", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(COPIES))).alias("_at"))
    return runs.select(*columns, "side", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("_n") - F.col("_at")))).alias("_copy")).drop("_copy")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return full_outer_diff(old, new, keys)


def agreement(entries: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per group and in total (null group): entries, hits, recall; found, precision."""
    side = lambda df, ref: df.select(*keys, *by, F.lit(ref).alias("in_reference"), F.lit(not ref).alias("in_index"))
    both = _collapsed(side(entries, True).unionByName(side(found, False)), [*keys, *by], ["in_reference", "in_index"], F.max)
    ref, idx, hit = (F.count_if(c) for c in (F.col("in_reference"), F.col("in_index"), F.col("in_reference") & F.col("in_index")))
    return both.rollup(*by).agg(ref.alias("entries"), idx.alias("found"), hit.alias("hits"), F.round(hit / F.nullif(ref, F.lit(0)), 6).alias("recall"), F.round(hit / F.nullif(idx, F.lit(0)), 6).alias("precision"))


def gate(old: DataFrame, new: DataFrame, warnings: int, by: str, metrics: list[str]) -> bool:
    """Publish only without parser warnings and with no metric of any group lower than before."""
    joined = old.select(by, *[F.col(m).alias(f"old_{m}") for m in metrics]).join(new, by, "left")
    fine = reduce(lambda a, b: a & b, [F.coalesce(F.col(m) >= F.col(f"old_{m}"), F.lit(False)) for m in metrics])
    return warnings == 0 and joined.filter(~fine).isEmpty()


def output_sizes(texts: DataFrame, name: str, text: str) -> DataFrame:
    """Characters, lines and estimated tokens (two characters each) of outputs."""
    t = F.col(text)
    return texts.select(name, F.length(t).alias("chars"), (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.floor(F.length(t) / 2).alias("tokens"))


def with_overrides(grades: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Grades with the values that an override gives."""
    o = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = grades.join(o, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in grades.columns])


def event_log(lines: DataFrame, schema: str = "type string, message struct<content:array<struct<type:string,name:string,text:string>>>, total_cost_usd double, num_turns int, usage struct<input_tokens:int,output_tokens:int>") -> DataFrame:
    """One row for each run of an agent's JSON log (run, value): calls, answer, cost, turns and tokens."""
    events = lines.select("run", F.from_json("value", schema).alias("e")).select("run", "e.*")
    parts = events.select("run", F.explode_outer("message.content").alias("c")).select("run", "c.*")
    calls = parts.groupBy("run").agg(F.count_if(F.coalesce(F.col("type") == "tool_use", F.lit(False))).alias("calls"), F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("type") == "tool_use", F.struct("name", F.lit(1)))))).alias("tools"))
    last = events.groupBy("run").agg(F.max("total_cost_usd").alias("cost"), F.max("num_turns").alias("turns"), F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"))
    return calls.select("run", "calls", F.map_keys("tools").alias("tools")).join(last, "run")


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def covered_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, n and covered: did a compiler read the line, as its listing tells?

    ``lines`` has key, n, statement, and what is known of each line: entry (a symbol is
    listed on it), one_line_if (the listing shows it whether or not it holds), names (it
    has symbols that a listing would name), echoed (the listing repeats it), and end_echoed
    (for an opening directive, whether the line that closes it is repeated).  The first that
    applies decides: an entry; a test on one line has nothing else to show for it; a line
    with names needs an entry somewhere in its statement; other lines have to be repeated,
    or their closing line.
    """
    in_statement = F.max("entry").over(Window.partitionBy(key, "statement"))
    covered = F.when(F.col("entry"), True).when(F.col("one_line_if"), False).when(F.col("names"), in_statement).otherwise(F.col("echoed") | F.col("end_echoed"))
    return lines.select(key, "n", covered.alias("covered"))
