"""Three-valued logic: SQL's nullable booleans are Kleene's values, NULL is undecided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceframe.functions.text import as_number, compare, unquoted


def kleene_and(value: Column) -> Column:
    """Conjunction as an aggregate: false if any is, else undecided if any is, else true."""
    return F.when(F.bool_or(~value), False).when(F.count(F.lit(1)) == F.count(value), True)


def kleene_or(value: Column) -> Column:
    return F.when(F.bool_or(value), True).when(F.count(F.lit(1)) == F.count(value), False)


def leaf_value(step: Column, settings: Column, compiled: Column) -> Column:
    """Value of one operand under the settings (lower-case keys) and the compile-time names.

    A compile-time name that is nowhere defined stands for its own text; one that is known
    but undecided makes the test undecided.  A run-time name has to be a setting.
    """
    name, missing = step["name"], F.lit(None).cast("boolean")
    own_text = F.concat(F.lit("%"), name, F.lit("%"))
    at_compile = F.when(~F.map_contains_key(compiled, name), compare(own_text, step["cmp"], step["value"])).otherwise(compare(F.element_at(compiled, name), step["cmp"], step["value"]))
    at_run = compare(F.try_element_at(settings, name), step["cmp"], step["value"])
    pair = compare(F.try_element_at(settings, name), step["cmp"], F.try_element_at(settings, step["value"]))
    return (
        F.when((step["op"] == "sw") & (step["mode"] == "compile"), at_compile)
        .when(step["op"] == "sw", at_run)
        .when(step["op"] == "sw2", pair)
        .when(step["op"] == "def", F.map_contains_key(compiled, name))
        .otherwise(missing)
    )


def evaluate(steps: Column, settings: Column, compiled: Column | None = None) -> Column:
    """Value of postfix steps: one fold with a stack of booleans."""
    compiled = settings if compiled is None else compiled
    top = lambda s, n: F.slice(s, F.size(s) - n + 1, n)
    rest = lambda s, n: F.slice(s, F.lit(1), F.size(s) - n)
    undecided = lambda a: F.exists(a, lambda x: x.isNull())

    def step(stack: Column, s: Column) -> Column:
        last = top(stack, s["n"])
        every = F.when(F.exists(last, lambda x: F.coalesce(~x, F.lit(False))), False).when(undecided(last), F.lit(None).cast("boolean")).otherwise(True)
        some = F.when(F.exists(last, lambda x: F.coalesce(x, F.lit(False))), True).when(undecided(last), F.lit(None).cast("boolean")).otherwise(False)
        return (
            F.when(s["op"] == "and", F.concat(rest(stack, s["n"]), F.array(every)))
            .when(s["op"] == "or", F.concat(rest(stack, s["n"]), F.array(some)))
            .when(s["op"] == "not", F.concat(rest(stack, F.lit(1)), F.array(~F.element_at(stack, -1))))
            .otherwise(F.concat(stack, F.array(leaf_value(s, settings, compiled))))
        )

    empty = F.array().cast("array<boolean>")
    return F.element_at(F.aggregate(steps, empty, step), -1)


def _against(left: tuple[Column, Column], cmp: str, right: tuple[Column, Column]) -> Column:
    """As ``compare``, for one known comparison and (value, number) of both sides worked out before."""
    (a, x), (b, y) = left, right
    number = {"eq": x == y, "ne": x != y, "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y}[cmp]
    word = {"eq": F.lower(a) == F.lower(b), "ne": F.lower(a) != F.lower(b)}.get(cmp, F.lit(None).cast("boolean"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(x.isNotNull() & y.isNotNull(), number).otherwise(word)


def expression(steps: list, names: dict[str, tuple[Column, Column, Column]]) -> Column:
    """Value of one parsed condition as a column of its own; ``names`` has (is it set, value, number) of every name it tests."""
    literal = lambda text: (unquoted(F.lit(text)), as_number(unquoted(F.lit(text))))
    stack: list[Column] = []
    for s in steps:
        if s.op in ("and", "or"):
            last, stack = stack[-s.n :], stack[: -s.n]
            stack.append(reduce(lambda a, b: a & b, last) if s.op == "and" else reduce(lambda a, b: a | b, last))
        elif s.op == "not":
            stack.append(~stack.pop())
        elif s.op == "sw":
            known, *held = names[s.name]
            value = _against(tuple(held), s.cmp, literal(s.value))
            stack.append(F.when(known, value).otherwise(_against(literal(f"%{s.name}%"), s.cmp, literal(s.value))) if s.mode == "compile" else value)
        elif s.op == "sw2" and s.value in names:
            stack.append(_against(names[s.name][1:], s.cmp, names[s.value][1:]))
        elif s.op == "def":
            stack.append(names[s.name][0])
        else:
            stack.append(F.lit(None).cast("boolean"))
    return stack[0]


def reach(rows: DataFrame, settings: str, conditions: dict[str, str]) -> DataFrame:
    """name, holds, undecided and configs of each condition (a short list) over the settings of all rows, in one pass.

    Each name that is tested is looked up and read as a number once for a row.
    """
    from traceframe.plans.conditions import parse

    told = [parse(text) for text in conditions.values()]
    tested = sorted({n for steps in told for s in steps if s.op in ("sw", "sw2", "def") for n in (s.name, s.value if s.op == "sw2" else None) if n})
    lookups = [c for i, n in enumerate(tested) for c in (F.map_contains_key(settings, n).alias(f"has{i}"), unquoted(F.try_element_at(settings, F.lit(n))).alias(f"value{i}"))]
    read = rows.select(*lookups).select("*", *[as_number(F.col(f"value{i}")).alias(f"number{i}") for i in range(len(tested))])
    names = {n: (F.col(f"has{i}"), F.col(f"value{i}"), F.col(f"number{i}")) for i, n in enumerate(tested)}
    valued = read.select(*[expression(steps, names).alias(f"c{i}") for i, steps in enumerate(told)])
    each = [F.struct(F.lit(name).alias("name"), F.count_if(f"c{i}").alias("holds"), F.count_if(F.col(f"c{i}").isNull()).alias("undecided"), F.count(F.lit(1)).alias("configs")) for i, name in enumerate(conditions)]
    return valued.agg(F.array(*each).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def tests_setting(steps: Column, settings: Column) -> Column:
    """Does any operand test a known setting, also inside a text that could not be read?"""
    known = lambda n: F.coalesce(F.map_contains_key(settings, n), F.lit(False))
    inside = lambda s: F.exists(F.split(F.coalesce(s["value"], F.lit("")), ","), lambda n: known(n))
    return F.exists(steps, lambda s: F.when(s["op"] == "unk", inside(s)).otherwise(s["name"].isNotNull() & known(F.coalesce(s["name"], F.lit("")))))


def parsed(texts: DataFrame, column: str = "text") -> DataFrame:
    """Each distinct text once, with its postfix steps (a small table; parsing is plain Python)."""
    from collections.abc import Iterator

    import pandas as pd

    from traceframe.plans.conditions import SCHEMA, parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({column: b[column], "steps": [[s._asdict() for s in parse(t)] for t in b[column]]})

    return texts.select(column).filter(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, steps {SCHEMA}")


def lower_keys(pairs: DataFrame, key: str, order: str, by: list[str]) -> DataFrame:
    """Keys in lower case; of spellings that clash the first in order counts."""
    return pairs.groupBy(*by, F.lower(F.trim(key)).alias(key)).agg(*[F.min_by(c, order).alias(c) for c in pairs.columns if c not in (key, order, *by)])
