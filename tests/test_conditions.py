"""Parsing of conditions: random expressions against Python's own evaluation, shapes of operands, unreadable texts."""

import random

import pytest
from pyspark.sql import functions as F

from traceframe.functions import kleene as K
from traceframe.plans.conditions import Step, parse


def _expression(rng, depth=0):
    """A random condition over k_0 .. k_3; missing brackets are left to precedence."""
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return f"k_{rng.randrange(4)} eq {rng.randrange(3)}"
    if kind < 0.5:
        return f"not ({_expression(rng, depth + 1)})"
    text = f" {rng.choice(['and', 'or'])} ".join(_expression(rng, depth + 1) for _ in range(rng.randint(2, 3)))
    return f"({text})" if rng.random() < 0.7 else text


def _steps_value(steps, k):
    stack = []
    for s in steps:
        if s.op in ("and", "or"):
            last = [stack.pop() for _ in range(s.n)]
            stack.append(all(last) if s.op == "and" else any(last))
        elif s.op == "not":
            stack.append(not stack.pop())
        else:
            stack.append(k[int(s.name[-1])] == int(s.value))
    assert len(stack) == 1
    return stack[0]


def test_random_expressions():
    rng = random.Random(5)
    for _ in range(500):
        text = _expression(rng)
        plain = text.replace(" eq ", " == ")
        for name in range(4):
            plain = plain.replace(f"k_{name}", f"k[{name}]")
        steps = parse(text)
        for _ in range(4):
            k = [rng.randrange(3) for _ in range(4)]
            assert _steps_value(steps, k) == eval(plain), text  # noqa: S307


def test_connectives_are_flat():
    assert [(s.op, s.n) for s in parse("k_0 eq 1 and (k_1 eq 1 and k_2 eq 1) and k_3 eq 1")][-1] == ("and", 4)
    assert [(s.op, s.n) for s in parse("(k_0 eq 1 or k_1 eq 1) or k_2 eq 1")][-1] == ("or", 3)


@pytest.mark.parametrize(
    ("text", "step"),
    [
        ("K_A eq .5", Step("sw", "k_a", "eq", ".5", "run")), ("k_a <> -2", Step("sw", "k_a", "ne", "-2", "run")), ("'%mode%' == \"fast\"", Step("sw", "mode", "eq", "fast", "compile")),
        ("3 <= %level%", Step("sw", "level", "le", "3", "compile")), ("k_a gt k_b", Step("sw2", "k_a", "gt", "k_b", "run")), ("(k_a + 1) ** 2 eq k_b", Step("other", None, None, "( k_a + 1 ) ** 2 eq k_b")),
        ("set mode", Step("def", "mode", None, "set", "compile")), ("exist 'a.gdx'", Step("env", None, None, "exist 'a.gdx'")), ("f(k_a and k_b)", Step("other", None, None, "f ( k_a and k_b )")),
    ],
)
def test_operands(text, step):
    got = parse(text)
    assert len(got) == 1 and got[0] == step


@pytest.mark.parametrize("text", ["", "k_a eq 1 and", "and k_a eq 1", "(k_a eq 1", "k_a eq 1)", "k_a eq 1 xor k_b eq 2", "$if k_a eq 1", "not", "()", "f(k_a]"])
def test_unreadable(text):
    assert [s.op for s in parse(text)] == ["unk"]


def test_values_under_settings(spark):
    settings = {"k_a": "9", "k_b": "2005", "mode": "Fast", "gone": "off"}
    cases = [
        ("k_a eq 9", True), ("k_a ne 9", False), ("k_a = 9 and k_b le 2005", True), ("k_a eq 6 or k_b gt 2020", False), ("not (k_a eq 6)", True), ('"%mode%" == "fast"', True), ("%mode% == 'slow'", False),
        ("k_a eq 9 and f(t)", None), ("k_a eq 6 and f(t)", False), ("k_a eq 9 or f(t)", True), ("k_c eq 1", None), ("ord(t) gt 1", None), ("'%unknown%' == '%unknown%'", None),
        ("not (k_a eq 9) and (k_b eq 2005 or k_b eq 9)", False), ("not (k_a eq 6) and (k_b eq 1 or k_b eq 2005)", True),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    held = F.create_map(*[F.lit(x) for kv in settings.items() for x in kv])
    got = {r.text: r.v for r in K.parsed(df).select("text", K.evaluate(F.col("steps"), held).alias("v")).collect()}
    assert {t: got[t] for t, _ in cases[:12]} == dict(cases[:12]) and all(got[t] is v for t, v in cases[13:])


def test_reach_equals_the_interpreted_fold(spark):
    from pyspark.sql import functions as F

    from traceframe.functions import kleene as K

    texts = ["cm_a eq 1", "cm_a ne 2 and cm_b eq 'on'", "not (cm_a gt 1.5 or cm_gone eq 1)", '"%cm_b%" == "ON"', '"%nowhere%" == "x"', '"%nowhere%" == "%nowhere%"', "cm_a eq cm_c", "cm_a lt cm_b", "cm_a eq other_name", "setglobal cm_a", "setglobal nope", "exist 'file'", "sameas(t, 'x')", "a xor b", "cm_b le 3"]
    rows = [{"cm_a": a, "cm_b": b, "cm_c": c} for a in ("1", "'2'", "x", None) for b in ("on", "Off", "2.5") for c in ("1.0", "X")] + [{}]
    held = spark.createDataFrame([(r,) for r in rows], "s map<string,string>")
    found = {r.name: (r.holds, r.undecided, r.configs) for r in K.reach(held, "s", {t: t for t in texts}).collect()}
    each = K.parsed(spark.createDataFrame([(t,) for t in texts], "text string")).crossJoin(held).select("text", K.evaluate(F.col("steps"), F.col("s")).alias("v"))
    want = {r.text: (r.holds, r.undecided, r.n) for r in each.groupBy("text").agg(F.count_if("v").alias("holds"), F.count_if(F.col("v").isNull()).alias("undecided"), F.count(F.lit(1)).alias("n")).collect()}
    assert found == want
