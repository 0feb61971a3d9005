"""Whether code runs under settings, as lines of text: realization, conditions, tests of switches, reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions import kleene as K
from traceframe.functions.text import compare, equation_condition, equation_domain
from traceframe.operators.settings import is_selected, module_off, realization_of

#: Tests of switches that a status names, at most.
TESTS = 4
#: Kinds of chunks whose tests are told.
CODE = ["equation", "gams_block", "declaration"]


def _verdict(value: Column, label: str) -> Column:
    return F.when(value, f"holds with {label}").when(~value, f"is off with {label}").otherwise("is left open by the settings")


def realization_line(module: Column, realization: Column, settings: Column, label: str) -> Column:
    """What selects the realization, null for code outside of one."""
    selected, chosen = is_selected(module, realization, settings), realization_of(module, settings)
    name = F.regexp_replace(module, "^[^_]*_", "")
    because = F.when(module_off(module, settings), F.concat(F.lit(" (the module is switched off: "), name, F.lit(" = "), chosen, F.lit(")")))
    because = because.otherwise(F.concat(F.lit(" ("), name, F.lit(" = "), chosen, F.lit(")")))
    return F.when(selected, F.concat(F.lit("realization "), realization, F.lit(f": selected by {label}"))).when(~selected, F.concat(F.lit("realization "), realization, F.lit(f": not selected by {label}"), because))


def chunk_status(chunks: DataFrame, parsed: DataFrame, tests: DataFrame, settings: Column, label: str = "the defaults") -> DataFrame:
    """id, place and text of the status lines of chunks: the realization, each condition, and up to TESTS tests of switches.

    ``chunks`` has id, kind, path, line_start, line_end, module, realization and conditions;
    ``parsed`` gives the steps of each condition (text, steps), ``tests`` the tests of lines
    (path, n, name, cmp, value), of which those of known settings are told, each once.
    """
    own = chunks.select("id", realization_line(F.col("module"), F.col("realization"), settings, label).alias("text")).filter("text is not null").select("id", F.lit(0).alias("place"), "text")
    each = chunks.select("id", F.posexplode("conditions").alias("i", "condition")).join(parsed.withColumnRenamed("text", "condition"), "condition")
    told = F.concat(F.lit("compiled only if "), F.regexp_replace(F.trim("condition"), r"\s+", " "), F.lit(": "), _verdict(K.evaluate(F.col("steps"), settings), label))
    conditions = each.select("id", (F.col("i") + 1).alias("place"), told.alias("text"))
    inside = chunks.filter(F.col("kind").isin(CODE)).select("id", "path", "line_start", "line_end").join(tests, "path").filter("n between line_start and line_end")
    known = inside.filter(F.map_contains_key(settings, F.col("name")))
    value = compare(F.try_element_at(settings, F.col("name")), _spelled(F.col("cmp")), F.col("value"))
    shown = F.concat_ws(" ", "name", "cmp", "value", F.lit("→"), F.coalesce(value.cast("string"), F.lit("open")))
    first = known.groupBy("id", shown.alias("shown")).agg(F.min("n").alias("n"))
    held = first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "shown"))), lambda x: x["shown"]).alias("all"))
    more = F.when(F.size("all") > TESTS, F.concat(F.lit(" (+"), F.size("all") - TESTS, F.lit(" more)"))).otherwise("")
    tested = held.select("id", F.lit(1_000).alias("place"), F.concat(F.lit(f"tests of switches, with {label}: "), F.array_join(F.slice("all", 1, TESTS), "; "), more).alias("text"))
    return own.unionByName(conditions).unionByName(tested)


def _spelled(cmp: Column) -> Column:
    """Comparisons by their words."""
    words = {"==": "eq", "=": "eq", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    out = cmp
    for sign, word in words.items():
        out = F.when(cmp == sign, word).otherwise(out)
    return out


def equation_status(equations: DataFrame, settings: Column) -> DataFrame:
    """id, condition and value of the equations (id, text) whose domain has a condition that tests a setting and does not hold."""
    conditions = equations.select("id", F.trim(equation_condition(equation_domain(F.col("text")))).alias("condition")).filter("condition is not null")
    bare = conditions.withColumn("condition", F.regexp_replace("condition", r"^\((.*)\)$", "$1"))
    parsed = K.parsed(bare, "condition")
    valued = bare.join(parsed, "condition").withColumn("value", K.evaluate(F.col("steps"), settings)).withColumn("tests", K.tests_setting(F.col("steps"), settings))
    return valued.filter(F.col("tests") & ~F.coalesce("value", F.lit(False))).select("id", "condition", "value")


def with_reach(reasons: DataFrame, reach: DataFrame) -> DataFrame:
    """``reasons`` (with text and off), the text of those that are off followed by how many configurations the condition holds in."""
    known = reach.select(F.col("name").alias("text"), F.concat(F.lit("; holds in "), "holds", F.lit(" of "), "configs", F.lit(" configurations")).alias("told"))
    return reasons.join(known, "text", "left").withColumn("text", F.when(F.col("off"), F.concat("text", F.coalesce("told", F.lit("")))).otherwise(F.col("text"))).select(reasons.columns)
