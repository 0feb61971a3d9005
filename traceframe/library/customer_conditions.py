"""Conditions and settings over customers and orders: K02, K05, K06, K08, K10, K12, K13, G01, G02."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import kleene as K
from traceframe.library.common import table
from traceframe.operators import settings as S

#: A condition for each pair of nation and segment, and what its parts are in SQL.
_TEXT = "'nation le ' || n || ' and not (segment eq ''' || s || ''' or gone_x eq 1)'"
_PAIRS = f"(SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """text, n and s: as many conditions as there are pairs of nation and segment."""
    pairs = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).filter("n is not null and s is not null").distinct()
    return pairs.withColumn("text", F.concat(F.lit("nation le "), F.col("n").cast("string"), F.lit(" and not (segment eq '"), "s", F.lit("' or gone_x eq 1)")))


def _held() -> F.Column:
    return F.create_map(F.lit("acctbal"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))


@query(
    "k02_steps_of_customers",
    f"""SELECT {_TEXT} AS text, x.i, x.op, x.name, x.cmp, x.value FROM {_PAIRS}, LATERAL (SELECT unnest([{{'i': 0, 'op': 'sw', 'name': 'nation', 'cmp': 'le', 'value': n::VARCHAR}}, {{'i': 1, 'op': 'sw', 'name': 'segment', 'cmp': 'eq', 'value': s}},
      {{'i': 2, 'op': 'sw', 'name': 'gone_x', 'cmp': 'eq', 'value': '1'}}, {{'i': 3, 'op': 'or', 'name': NULL, 'cmp': NULL, 'value': NULL}}, {{'i': 4, 'op': 'not', 'name': NULL, 'cmp': NULL, 'value': NULL}}, {{'i': 5, 'op': 'and', 'name': NULL, 'cmp': NULL, 'value': NULL}}]) AS x)""",
)
def k02(spark: SparkSession, d: str) -> DataFrame:
    return K.parsed(_texts(spark, d)).select("text", F.posexplode("steps").alias("i", "s")).select("text", "i", "s.op", "s.name", "s.cmp", "s.value")


@query("k05_values_of_customers", f"SELECT c_custkey, c_nationkey <= 12 AND NOT (lower(c_mktsegment) = lower(s) OR NULL) AS value FROM customer JOIN {_PAIRS} ON n = 12 AND ascii(s) % 2 = c_custkey % 2")
def k05(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that speak of nation 12, under the settings of customers."""
    parsed = K.parsed(_texts(spark, d)).join(_texts(spark, d).filter("n = 12"), "text").select("steps", (F.ascii("s") % 2).cast("bigint").alias("half"))
    customers = table(spark, d, "customer").select("c_custkey", _held().alias("held"), (F.col("c_custkey") % 2).alias("half"))
    return customers.join(F.broadcast(parsed), "half").select("c_custkey", K.evaluate(F.col("steps"), F.col("held")).alias("value"))


COMPILED = [('"%segment%" == "machinery"', "lower(c_mktsegment) = 'machinery'"), ('"%gone%" == "x" or %nation% ge 10', "false OR c_nationkey >= 10"), ("set segment and not set gone", "c_mktsegment IS NOT NULL")]


@query("k06_compiled_under_customers", " UNION ALL ".join(f"SELECT c_custkey, {i} AS rule, {sql} AS value FROM customer WHERE c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL" for i, (_, sql) in enumerate(COMPILED)))
def k06(spark: SparkSession, d: str) -> DataFrame:
    """Compile-time tests, with the settings of a customer as compile-time names: one that is nowhere defined stands for its own text."""
    from traceframe.library.common import fixture

    rules = fixture(spark, "rule int, text string", [(i, t) for i, (t, _) in enumerate(COMPILED)])
    steps = [r.steps for r in K.parsed(rules).join(rules, "text").orderBy("rule").select("steps").collect()]
    none = F.create_map(F.lit("z"), F.lit("0"))
    rows = table(spark, d, "customer").filter("c_mktsegment is not null and c_nationkey is not null").withColumn("held", _held())
    kind = K.parsed(rules).schema["steps"].dataType
    told = [F.struct(F.lit(i).alias("rule"), K.evaluate(F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(s, kind.elementType.fields, strict=True)]) for s in one]), none, F.col("held")).alias("value")) for i, one in enumerate(steps)]
    return rows.select("c_custkey", F.inline(F.array(*told)))


@query("k08_tests_of_customers", f"SELECT {_TEXT} AS text, true AS nation, s = 'x' AS other FROM {_PAIRS}")
def k08(spark: SparkSession, d: str) -> DataFrame:
    """Does a condition test a known setting?"""
    parsed = K.parsed(_texts(spark, d))
    known = lambda name: K.tests_setting(F.col("steps"), F.create_map(F.lit(name), F.lit("1")))
    return parsed.select("text", known("nation").alias("nation"), known("acctbal").alias("other"))


@query("k10_lower_keys_of_orders", "SELECT o_custkey, lower(trim(key)) AS key, arg_min(o_orderkey, o_orderkey) AS value FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_orderpriority ELSE upper(o_orderpriority) END AS key FROM orders) GROUP BY 1, 2")
def k10(spark: SparkSession, d: str) -> DataFrame:
    """Priorities in two spellings: of those that clash the first order counts."""
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.upper("o_orderpriority"))
    pairs = table(spark, d, "orders").select("o_custkey", key.alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderkey").alias("n"))
    return K.lower_keys(pairs, "key", "n", ["o_custkey"])


@query("k12_constant_tests_of_customers", f"SELECT {_TEXT} AS text, CASE WHEN n >= 0 THEN 'depends' END AS verdict FROM {_PAIRS} UNION ALL SELECT 'segment eq ''' || s || '''', 'never' FROM {_PAIRS} GROUP BY s UNION ALL SELECT 'segment ne ''' || s || ''' or nation le 3', 'always' FROM {_PAIRS} GROUP BY s")
def k12(spark: SparkSession, d: str) -> DataFrame:
    """Is a condition constant when the segment has a value that equals nothing?"""
    own = _texts(spark, d)
    segments = own.select("s").distinct()
    texts = own.select("text").unionByName(segments.select(F.concat(F.lit("segment eq '"), "s", F.lit("'")).alias("text"))).unionByName(segments.select(F.concat(F.lit("segment ne '"), "s", F.lit("' or nation le 3")).alias("text")))
    v = K.evaluate(F.col("steps"), F.create_map(F.lit("segment"), F.lit("\u0001")))
    return K.parsed(texts).select("text", F.when(v, "always").when(~v, "never").otherwise("depends").alias("verdict"))


@query("k13_switch_only_of_customers", f"SELECT {_TEXT} AS text, false AS switch_only FROM {_PAIRS} UNION ALL SELECT 'nation eq ' || n, true FROM {_PAIRS} GROUP BY n")
def k13(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("nation", "segment", "acctbal")])
    own = F.forall("steps", lambda s: s["op"].isin("and", "or", "not") | (s["op"].isin("sw", "sw2", "def") & F.coalesce(F.array_contains(names, s["name"]), F.lit(False))))
    texts = _texts(spark, d)
    return K.parsed(texts.select("text").unionByName(texts.select(F.concat(F.lit("nation eq "), F.col("n").cast("string")).alias("text")))).select("text", own.alias("switch_only"))


@query("g01_defaults_of_orders", "SELECT lower(trim(o_orderpriority)) AS key, arg_min(o_orderstatus, (o_orderstatus, o_orderkey)) AS value FROM orders GROUP BY 1")
def g01(spark: SparkSession, d: str) -> DataFrame:
    """Defaults by priority: the order that comes first by status and number says the value."""
    rows = table(spark, d, "orders").select(F.upper("o_orderpriority").alias("name"), F.concat(F.lit("'"), "o_orderstatus", F.lit("'")).alias("value"), F.col("o_orderstatus").alias("path"), F.col("o_orderkey").alias("line"))
    return S.defaults(rows).select(F.explode("settings").alias("key", "value"))


@query(
    "g02_overrides_of_customers",
    "SELECT c_custkey, x.key, x.value FROM customer, LATERAL (SELECT unnest([{'key': 'nation', 'value': coalesce(c_nationkey::VARCHAR, '0')}, {'key': 'segment', 'value': CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END}, {'key': 'kept', 'value': 'yes'}]) AS x)",
)
def g02(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is a scenario that overrides the nation, and every second one the segment; a setting that is none is not taken."""
    base = F.create_map(*[F.lit(x) for x in ("nation", "0", "segment", "none", "kept", "yes")])
    segment = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).otherwise("  ")
    cells = F.create_map(F.lit(" Nation "), F.col("c_nationkey").cast("string"), F.lit("SEGMENT"), segment, F.lit("unknown"), F.lit("1"))
    return table(spark, d, "customer").select("c_custkey", F.explode(S.override(base, S.normal_cells(cells))).alias("key", "value"))
