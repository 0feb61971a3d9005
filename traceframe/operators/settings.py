"""Settings tables: defaults, overrides, inheritance, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions.kleene import evaluate, tests_setting
from traceframe.functions.text import unquoted
from traceframe.plans.scratch import materialize


def defaults(switches: DataFrame) -> DataFrame:
    """One row with the map of lower-case names to values without quotes; of clashing names the first in (path, line) counts."""
    named = switches.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min_by(unquoted(F.col("value")), F.struct("path", "line")).alias("value"))
    return named.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("settings"))


def override(base: Column, cells: Column) -> Column:
    """Settings with the cells that name a setting in place of its value (keys of both in lower case)."""
    return F.map_from_entries(F.transform(F.map_entries(base), lambda e: F.struct(e["key"], F.coalesce(F.try_element_at(cells, e["key"]), e["value"]))))


def normal_cells(cells: Column) -> Column:
    """Keys trimmed and in lower case, values without quotes; blank cells are absent."""
    kept = F.map_filter(cells, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    pairs = F.transform(F.map_entries(kept), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), unquoted(e["value"]).alias("value")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def pick_scenario(rows: DataFrame, name: str, is_side: Column) -> DataFrame:
    """The first row of that name (in any case) that is not on the other side, the main file first."""
    w = Window.orderBy("path", "line")
    return rows.filter((F.lower("name") == name.lower()) & ~is_side).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def inherit(rows: DataFrame) -> DataFrame:
    """``rows`` (path, line, name, parent, cells) with the cells of the parents filled in.

    A parent is the latest earlier row of that name in the same file; its own parents
    count too.  The chain is followed by doubling, so the rounds grow with the logarithm
    of the longest chain.
    """
    earlier = rows.select("path", F.col("line").alias("up"), F.col("name").alias("parent"))
    linked = rows.join(earlier, ["path", "parent"], "left").filter("up is null or up < line")
    up = linked.groupBy("path", "line").agg(F.max("up").alias("up"))
    state = rows.select("path", "line", "name", "parent", "cells").join(up, ["path", "line"], "left")
    while True:
        state = materialize(state, "inherit")
        if state.filter("up is not null").isEmpty():
            return state.drop("up")
        above = state.select("path", F.col("line").alias("up"), F.col("cells").alias("more"), F.col("up").alias("next"))
        filled = F.map_concat("cells", F.map_filter("more", lambda k, v: ~F.map_contains_key("cells", k)))
        joined = state.join(above, ["path", "up"], "left")
        state = joined.select("path", "line", "name", "parent", F.when(F.col("more").isNull(), F.col("cells")).otherwise(filled).alias("cells"), F.col("next").alias("up"))


def realization_of(module: Column, settings: Column) -> Column:
    """Value of the setting named like the module behind its number."""
    return F.try_element_at(settings, F.lower(F.regexp_replace(module, "^[^_]*_", "")))


def is_selected(module: Column, realization: Column, settings: Column) -> Column:
    """Three-valued: null outside a realization or where the module has no setting."""
    return F.when(realization.isNotNull(), F.lower(realization_of(module, settings)) == F.lower(realization))


def module_off(module: Column, settings: Column) -> Column:
    return F.lower(realization_of(module, settings)).isin("off", "none")


def compile_environment(flags: DataFrame, settings: Column) -> DataFrame:
    """name and value of compile-time variables: rows (name, path, line, value, steps).

    Any undecided defining line makes the value unknown; else the last line that holds
    gives it; a value that holds a percent sign is unknown; none that holds: absent.
    """
    held = flags.withColumn("holds", F.when(F.size("steps") == 0, True).otherwise(evaluate(F.col("steps"), settings)))
    last = F.max_by(F.when(F.col("holds"), F.col("value")), F.when(F.col("holds"), F.struct("path", "line")))
    by = held.groupBy(F.lower("name").alias("name")).agg(F.bool_or(F.col("holds").isNull()).alias("open"), F.coalesce(F.bool_or("holds"), F.lit(False)).alias("any"), last.alias("value"))
    return by.filter("open or any").select("name", F.when(~F.col("open") & ~F.contains("value", F.lit("%")), F.col("value")).alias("value"))


def reasons(uses: DataFrame, settings: str = "settings") -> DataFrame:
    """Rows of reasons why a use does not run for certain.

    ``uses`` has use_id, module, realization, settings and ``tests``: kind (ifthen, guard),
    text and steps, in order.  Kinds: the realization that is not selected (off), compile
    conditions that are not true, guards that are false, or undecided if they test a setting.
    """
    s = F.col(settings)
    selected = is_selected(F.col("module"), F.col("realization"), s)
    first = uses.filter(selected == F.lit(False)).select("use_id", F.lit(0).alias("place"), F.concat("realization", F.lit(" is not selected")).alias("text"), F.lit(True).alias("off"))
    each = uses.select("use_id", settings, F.posexplode("tests").alias("i", "t"))
    value = each.select("use_id", (F.col("i") + 1).alias("place"), F.col("t.text").alias("text"), F.col("t.kind").alias("kind"), evaluate(F.col("t.steps"), s).alias("v"), tests_setting(F.col("t.steps"), s).alias("of_setting"))
    counts = value.filter("v is not true and (kind = 'ifthen' or v is false or of_setting)")
    return first.unionByName(counts.select("use_id", "place", "text", F.coalesce(~F.col("v"), F.lit(False)).alias("off")))


def marks(uses: DataFrame, found: DataFrame) -> DataFrame:
    """use_id, mark and rank: off if any reason is, undecided if there is any other, else runs."""
    by = found.groupBy("use_id").agg(F.bool_or("off").alias("off"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "; ").alias("why"))
    rank = F.when(F.col("off"), 2).when(F.col("off").isNotNull(), 1).otherwise(0)
    mark = F.when(rank == 2, "⚠").when(rank == 1, "?").otherwise("✓")
    return uses.select("use_id").join(by, "use_id", "left").select("use_id", mark.alias("mark"), rank.alias("rank"), F.coalesce("why", F.lit("")).alias("why"))
