"""Three-valued conditions K01-K13, reach A11, J22."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import kleene as K
from traceframe.library.common import fixture, table, values

SETTINGS = {"k_level": "4", "k_year": "1990", "mode": "Quick", "storage": "tank"}
_OPEN = "CAST(NULL AS BOOLEAN)"
#: Tests, and what each is in SQL under the settings; what depends on data or on an unknown name is null.
LEAVES = [
    ("k_level eq 4", "4 = 4"), ("k_year gt 2000", "1990 > 2000"), ('"%mode%" == "quick"', "lower('Quick') = 'quick'"), ("%storage% <> 'tank'", "'tank' <> 'tank'"), (".5 < %k_level%", "true"),
    ("k_gone eq 1", _OPEN), ("f(t, r) gt 1", _OPEN),
]
_PAIRS = [(x, y) for x in LEAVES for y in LEAVES if ".5" not in x[0] + y[0]]
CASES = [
    (x, sql) for x, sql in LEAVES if ".5" not in x
] + [(f"not ({x})", f"NOT ({p})") for x, p in LEAVES if ".5" not in x] + [
    (f"{x} {word} {y}", f"({p}) {word} ({q})") for (x, p), (y, q) in _PAIRS for word in ("and", "or")
] + [(f"not ({x} or {y}) and k_level le 4", f"NOT (({p}) OR ({q})) AND 4 <= 4") for (x, p), (y, q) in _PAIRS] + [("k_level eq 4 xor k_year eq 1", _OPEN)]
TEXTS = [t for t, _ in CASES]


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _texts(spark: SparkSession) -> DataFrame:
    return fixture(spark, "text string", [(t,) for t in TEXTS])


#: The steps of the tests above as (op, name, comparison, value, mode, operands), and those of the cases put together from them.
STEPS = {
    "k_level eq 4": ("sw", "k_level", "eq", "4", "run", None), "k_year gt 2000": ("sw", "k_year", "gt", "2000", "run", None), '"%mode%" == "quick"': ("sw", "mode", "eq", "quick", "compile", None),
    "%storage% <> 'tank'": ("sw", "storage", "ne", "tank", "compile", None), "k_gone eq 1": ("sw", "k_gone", "eq", "1", "run", None), "f(t, r) gt 1": ("other", None, None, "f ( t , r ) gt 1", None, None),
}
_AND, _OR, _NOT = (("and", *[None] * 4, 2), ("or", *[None] * 4, 2), ("not", *[None] * 5))
_POSTFIX = [[s] for s in STEPS.values()] + [[s, _NOT] for s in STEPS.values()] + [[STEPS[x], STEPS[y], word] for (x, _), (y, _) in _PAIRS for word in (_AND, _OR)]
_POSTFIX += [[STEPS[x], STEPS[y], _OR, _NOT, ("sw", "k_level", "le", "4", "run", None), _AND] for (x, _), (y, _) in _PAIRS] + [[("unk", None, None, "k_level,k_year", None, None)]]


@query("k02_parsed_steps", "SELECT * FROM (" + f"WITH {values('t', 'text, i, op, name, cmp, value, mode, n', [(t, i, *s) for t, steps in zip(TEXTS, _POSTFIX, strict=True) for i, s in enumerate(steps)])} SELECT text, i::INT AS i, op, name, cmp, value, mode, n::INT AS n FROM t)")
def k02(spark: SparkSession, d: str) -> DataFrame:
    return K.parsed(_texts(spark)).select("text", F.posexplode("steps").alias("i", "s")).select("text", "i", "s.*")


@query("k05_condition_values", "SELECT * FROM (VALUES " + ", ".join(f"({_sql_text(t)}, {sql})" for t, sql in CASES) + ") t(text, value)")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """SQL's own connectives say what the evaluation has to give."""
    held = F.create_map(*[F.lit(x) for kv in SETTINGS.items() for x in kv])
    return K.parsed(_texts(spark)).select("text", K.evaluate(F.col("steps"), held).alias("value"))


ENV = [(1, "a", "x"), (2, "b", None), (3, "c", "1")]
COMPILED = ["%a% == 'x'", "%b% == 'x'", "%gone% == 'x'", "not (%gone% == 'x')", "set a", "set gone", "%c% eq 1", "cm_gone eq 1", "a_x eq a_y"]


@query("k06_compile_environment", f"WITH {values('t', 'text, value', list(zip(COMPILED, [True, None, False, True, True, False, True, None, None], strict=True)))} SELECT text, CAST(value AS BOOLEAN) AS value FROM t")
def k06(spark: SparkSession, d: str) -> DataFrame:
    known = F.map_from_arrays(F.array(*[F.lit(k) for _, k, _ in ENV]), F.array(*[F.lit(v) for _, _, v in ENV]))
    none = F.create_map(F.lit("z"), F.lit("0"))
    return K.parsed(fixture(spark, "text string", [(t,) for t in COMPILED])).select("text", K.evaluate(F.col("steps"), none, known).alias("value"))


@query("k08_tests_setting", f"WITH {values('t', 'text', [(t,) for t in TEXTS])} SELECT text, regexp_matches(text, '{'|'.join(SETTINGS)}') AS value FROM t")
def k08(spark: SparkSession, d: str) -> DataFrame:
    held = F.create_map(*[F.lit(x) for kv in SETTINGS.items() for x in kv])
    return K.parsed(_texts(spark)).select("text", K.tests_setting(F.col("steps"), held).alias("value"))


_V = "CASE WHEN event_type = 'error' THEN NULL ELSE value > 5 END"


@query(
    "k09_conjunction_per_group",
    f"SELECT user_id, CASE WHEN bool_or(NOT v) THEN false WHEN count(*) = count(v) THEN true END AS every, CASE WHEN bool_or(v) THEN true WHEN count(*) = count(v) THEN false END AS some FROM (SELECT user_id, {_V} AS v FROM events) GROUP BY 1",
)
def k09(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("event_type") != "error", F.col("value") > 5)
    return table(spark, d, "events").select("user_id", v.alias("v")).groupBy("user_id").agg(K.kleene_and(F.col("v")).alias("every"), K.kleene_or(F.col("v")).alias("some"))


KEYS = [(1, "CM_a", "1", 2), (1, "cm_A ", "2", 1), (1, "b", "x", 3), (2, "B", "y", 1)]


@query("k10_lower_keys", f"WITH {values('t', 's, key, value, n', KEYS)} SELECT s, lower(trim(key)) AS key, arg_min(value, n) AS value FROM t GROUP BY 1, 2")
def k10(spark: SparkSession, d: str) -> DataFrame:
    return K.lower_keys(fixture(spark, "s int, key string, value string, n int", KEYS), "key", "n", ["s"])


_ORDERS = "CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderstatus = 'F' END"


@query("k07_condition_over_orders", f"SELECT o_orderkey, ({_ORDERS}) AND o_totalprice > 200000 AS both, ({_ORDERS}) OR o_totalprice > 200000 AS any, NOT ({_ORDERS}) AS no FROM orders")
def k07(spark: SparkSession, d: str) -> DataFrame:
    """SQL's own connectives are Kleene's."""
    a = F.when(~F.col("o_orderpriority").like("5%"), F.col("o_orderstatus") == "F")
    b = F.col("o_totalprice") > 200000
    return table(spark, d, "orders").select("o_orderkey", (a & b).alias("both"), (a | b).alias("any"), (~a).alias("no"))


RULES = [("rich", "acctbal gt 5000"), ("nation_low", "nation le 5"), ("machines", "segment eq 'MACHINERY'"), ("rich_low", "acctbal gt 5000 and nation le 5"), ("unknown", "acctbal gt 0 and gone_x eq 1"), ("low_or", "nation le 5 or gone_x eq 1")]
_B = "c_acctbal"


@query(
    "a11_reach",
    f"""SELECT rule, count(*) FILTER (v) AS holds, count(*) FILTER (v IS NULL) AS undecided, count(*) AS configs FROM (SELECT unnest(['rich', 'nation_low', 'machines', 'rich_low', 'unknown', 'low_or']) AS rule,
    unnest([c_acctbal > 5000, c_nationkey <= 5, c_mktsegment = 'MACHINERY', c_acctbal > 5000 AND c_nationkey <= 5, c_acctbal > 0 AND NULL, c_nationkey <= 5 OR NULL]) AS v FROM customer) GROUP BY 1""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    """Every rule against every settings row: few rules, so each is an expression of its own, and all are counted in one pass."""
    held = F.create_map(F.lit("acctbal"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    return K.reach(table(spark, d, "customer").select(held.alias("s")), "s", dict(RULES)).withColumnRenamed("name", "rule")


@query("k12_constant_test", f"WITH {values('t', 'text, verdict', [('cm_bad eq 1', 'never'), ('cm_bad ne 1', 'always'), ('cm_bad eq 1 and cm_b eq 2', 'never'), ('cm_b eq 2', 'depends')])} SELECT * FROM t")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Is a condition constant when a setting has a value that equals nothing?"""
    texts = fixture(spark, "text string", [("cm_bad eq 1",), ("cm_bad ne 1",), ("cm_bad eq 1 and cm_b eq 2",), ("cm_b eq 2",)])
    impossible = F.create_map(F.lit("cm_bad"), F.lit("\u0001"))
    v = K.evaluate(F.col("steps"), impossible)
    return K.parsed(texts).select("text", F.when(v, "always").when(~v, "never").otherwise("depends").alias("verdict"))


@query("k13_switch_only", f"WITH {values('t', 'text', [(t,) for t in TEXTS])} SELECT text, NOT regexp_matches(text, 'f\\(|k_gone|xor') AS switch_only FROM t")
def k13(spark: SparkSession, d: str) -> DataFrame:
    """Does a condition consist of tests of settings alone?"""
    names = F.array(*[F.lit(n) for n in SETTINGS])
    own = F.forall("steps", lambda s: s["op"].isin("and", "or", "not") | (s["op"].isin("sw", "sw2", "def") & F.coalesce(F.array_contains(names, s["name"]), F.lit(False))))
    return K.parsed(_texts(spark)).select("text", own.alias("switch_only"))
