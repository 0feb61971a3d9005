"""Settings and verdicts G01-G12, preconditions T18-T19, configuration use T14-T15."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import kleene as K
from traceframe.library.common import fixture, table, values
from traceframe.operators import settings as S

SWITCHES = [("k_FirstYear", "1990", "main.gms", 4), ("storage", "'tank'", "main.gms", 7), ("k_on", '"yes"', "main.gms", 8), ("K_On", "no", "main.gms", 12), ("k_rate", "0.5", "main.gms", 15)]
ROWS = [
    ("Base", "config/main_runs.csv", 3, {"storage": "", " k_firstyear": "'2010'", "Storage ": "none", "grid": "G4"}),
    ("base", "config/other_runs.csv", 1, {"k_rate": "0.9"}),
    ("Side", "config/side/runs.csv", 2, {"k_rate": "0.1"}),
]


def _defaults(spark: SparkSession) -> DataFrame:
    return S.defaults(fixture(spark, "name string, value string, path string, line int", SWITCHES))


@query("g01_defaults", f"WITH {values('t', 'name, value, path, line', SWITCHES)} SELECT lower(name) AS key, arg_min(regexp_replace(value, '^[\"'']+|[\"'']+$', '', 'g'), line) AS value FROM t GROUP BY 1")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return _defaults(spark).select(F.explode("settings").alias("key", "value"))


_CELLS = [(n, p, line, k, v) for n, p, line, cells in ROWS for k, v in cells.items()]


@query(
    "g02_scenario_override",
    f"""WITH {values('t', 'name, value, path, line', SWITCHES)}, {values('c', 'name, path, line, key, cell', _CELLS)},
    base AS (SELECT lower(name) AS key, arg_min(trim(value, '"'' '), line) AS value FROM t GROUP BY 1),
    row AS (SELECT path, line FROM c WHERE lower(name) = 'base' AND NOT contains(path, '/side/') ORDER BY path, line LIMIT 1),
    own AS (SELECT lower(trim(key)) AS key, trim(cell, '"'' ') AS cell FROM c JOIN row USING (path, line) WHERE trim(cell) <> '')
    SELECT key, coalesce(cell, value) AS value FROM base LEFT JOIN own USING (key)""",
)
def g02(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, "name string, path string, line int, cells map<string,string>", ROWS)
    row = S.pick_scenario(rows, "BASE", F.contains("path", F.lit("/side/"))).select(S.normal_cells(F.col("cells")).alias("cells"))
    held = _defaults(spark).join(F.broadcast(row)).select(S.override(F.col("settings"), F.col("cells")).alias("s"))
    return held.select(F.explode("s").alias("key", "value"))


FLAGS = [
    ("k_fast", "core/a.gms", 1, "1", '"%k_mode%" == "one"'), ("k_slow", "core/a.gms", 2, "1", '"%k_mode%" == "two"'), ("K_last", "core/b.gms", 1, "first", ""), ("k_last", "core/b.gms", 4, "second", "k_other eq 'x'"),
    ("k_last", "core/b.gms", 6, "third", "k_other eq 'y'"), ("k_file", "core/b.gms", 8, "v", 'exist "./x"'), ("k_text", "core/b.gms", 9, "%k_mode%", ""),
]
#: What each line's condition is in SQL, under k_mode = one and k_other = y.
_HOLDS = ["'one' = 'one'", "'one' = 'two'", "true", "'y' = 'x'", "'y' = 'y'", "CAST(NULL AS BOOLEAN)", "true"]


@query(
    "g04_compile_time_flags",
    f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{n.lower()}', '{p}', {line}, '{v}', {h})" for (n, p, line, v, _), h in zip(FLAGS, _HOLDS, strict=True))}) x(name, path, line, value, holds)),
    b AS (SELECT name, bool_or(holds IS NULL) AS open, coalesce(bool_or(holds), false) AS met, arg_max(value, (path, line)) FILTER (holds) AS value FROM t GROUP BY 1)
    SELECT name, CASE WHEN NOT open AND NOT contains(value, '%') THEN value END AS value FROM b WHERE open OR met""",
)
def g04(spark: SparkSession, d: str) -> DataFrame:
    flags = fixture(spark, "name string, path string, line int, value string, text string", FLAGS)
    parsed = flags.join(K.parsed(flags.filter("text <> ''")), "text", "left").withColumn("steps", F.coalesce("steps", F.expr("filter(array(named_struct('op','a','name','a','cmp','a','value','a','mode','a','n',1)), x -> false)")))
    held = F.create_map(F.lit("k_mode"), F.lit("one"), F.lit("k_other"), F.lit("y"))
    return S.compile_environment(parsed, held)


#: Conditions of uses, what they are in SQL under the defaults, and whether they test a setting.
TESTS_OF_USES = {
    "k_on eq 'yes'": ("'yes' = 'yes'", True), "k_FirstYear gt 2005": ("1990 > 2005", True), 'exist "./x.inc"': ("CAST(NULL AS BOOLEAN)", False), "ord(t) gt 1": ("CAST(NULL AS BOOLEAN)", False),
    "k_firstyear gt 1980 and ord(t) gt 1": ("1990 > 1980 AND CAST(NULL AS BOOLEAN)", True),
}
USES = [
    (1, "12_storage", "tank", [("ifthen", "k_on eq 'yes'")]), (2, "12_storage", "none", [("guard", "k_on eq 'yes'")]), (3, None, None, [("guard", "k_FirstYear gt 2005")]),
    (4, None, None, [("ifthen", 'exist "./x.inc"'), ("guard", "ord(t) gt 1")]), (5, None, None, [("guard", "k_firstyear gt 1980 and ord(t) gt 1")]), (6, "03_trade", "free", []),
    (7, "12_storage", "none", [("ifthen", "k_FirstYear gt 2005"), ("guard", "ord(t) gt 1")]),
]
_OFF = "lower(realization) <> 'tank' AND module = '12_storage'"
_REASONS = f"""{values('u', 'use_id, module, realization', [u[:3] for u in USES])}, {values('e', 'use_id, place, kind, text', [(u[0], i + 1, k, t) for u in USES for i, (k, t) in enumerate(u[3])])},
  v AS (SELECT * FROM (VALUES {', '.join(f"({chr(39)}{t.replace(chr(39), chr(39) * 2)}{chr(39)}, {sql}, {own})" for t, (sql, own) in TESTS_OF_USES.items())}) x(text, v, own)),
  r AS (SELECT use_id, 0 AS place, realization || ' is not selected' AS text, true AS off FROM u WHERE {_OFF}
    UNION ALL SELECT use_id, place, text, coalesce(NOT v, false) FROM e JOIN v USING (text) WHERE v IS NOT TRUE AND (kind = 'ifthen' OR v IS FALSE OR own))"""


def _uses(spark: SparkSession) -> DataFrame:
    uses = fixture(spark, "use_id int, module string, realization string, raw array<struct<kind:string,text:string>>", USES)
    texts = K.parsed(uses.select(F.explode("raw.text").alias("text")))
    each = uses.select("use_id", F.posexplode("raw").alias("i", "r")).select("use_id", "i", "r.*").join(texts, "text")
    tests = each.groupBy("use_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "kind", "text", F.col("steps")))), lambda x: x.dropFields("i")).alias("tests"))
    none = F.expr("filter(array(named_struct('kind','a','text','a','steps',array(named_struct('op','a','name','a','cmp','a','value','a','mode','a','n',1)))), x -> false)")
    joined = uses.join(tests, "use_id", "left").join(F.broadcast(_defaults(spark)))
    return joined.select("use_id", "module", "realization", "settings", F.coalesce("tests", none).alias("tests"))


@query("g08_reasons", f"WITH {_REASONS} SELECT use_id, place, text, off FROM r")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return S.reasons(_uses(spark))


@query(
    "g09_marks",
    f"""WITH {_REASONS}, b AS (SELECT use_id, max(CASE WHEN off THEN 2 ELSE 1 END) AS rank FROM r GROUP BY 1)
    SELECT u.use_id, ['✓', '?', '⚠'][coalesce(rank, 0) + 1] AS mark, coalesce(rank, 0) AS rank FROM u LEFT JOIN b USING (use_id)""",
)
def g09(spark: SparkSession, d: str) -> DataFrame:
    uses = _uses(spark)
    return S.marks(uses, S.reasons(uses)).select("use_id", "mark", "rank")


@query("g05_realization_of_module", "SELECT event_id, json_extract_string(props, '$.k') AS realization, (json_extract_string(props, '$.k'))::INT > 90 AS off FROM events")
def g05(spark: SparkSession, d: str) -> DataFrame:
    """The setting is looked up under the name behind the module's number."""
    held = F.from_json("props", "map<string,string>")
    value = S.realization_of(F.lit("07_K"), held)
    return table(spark, d, "events").select("event_id", value.alias("realization"), (value.cast("int") > 90).alias("off"))


@query("g07_selected", "SELECT event_id, CASE WHEN event_type <> 'error' THEN lower(event_type) = 'click' END AS selected FROM events")
def g07(spark: SparkSession, d: str) -> DataFrame:
    held = F.create_map(F.lit("kind"), F.lit("Click"))
    realization = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, d, "events").select("event_id", S.is_selected(F.lit("03_kind"), realization, held).alias("selected"))


TESTS = [("cm_a", "2"), ("cm_a", "9"), ("storage", "gone"), ("storage", "none"), ("cm_new", "1"), ("vm_x", "1")]
DECLARED = [("cm_a", "main", "1|2"), ("cm_a", "declared", ""), ("storage", "setglobal", "none|tank"), ("vm_x", "declared", "")]


@query(
    "t18_checked_tests",
    f"""WITH {values('t', 'name, value', TESTS)}, {values('s', 'name, source, allowed', DECLARED)}, b AS (SELECT name, arg_min(source, p) AS source, arg_min(allowed, p) AS allowed FROM (SELECT *, list_position(['main', 'setglobal', 'declared'], source) AS p FROM s) GROUP BY 1)
    SELECT t.name, t.value, coalesce(source, 'unknown') AS source, CASE WHEN source IS NULL THEN 'no such setting' WHEN allowed <> '' AND NOT regexp_full_match(t.value, allowed) THEN 'value not allowed' ELSE '' END AS problem FROM t LEFT JOIN b USING (name)""",
)
def t18(spark: SparkSession, d: str) -> DataFrame:
    rank = F.array_position(F.array(F.lit("main"), F.lit("setglobal"), F.lit("declared")), F.col("source"))
    best = fixture(spark, "name string, source string, allowed string", DECLARED).groupBy("name").agg(F.min_by("source", rank).alias("source"), F.min_by("allowed", rank).alias("allowed"))
    bad = (F.col("allowed") != "") & ~F.regexp_like("value", F.concat(F.lit("^(?:"), "allowed", F.lit(")$")))
    problem = F.when(F.col("source").isNull(), "no such setting").when(bad, "value not allowed").otherwise("")
    return fixture(spark, "name string, value string", TESTS).join(best, "name", "left").select("name", "value", F.coalesce("source", F.lit("unknown")).alias("source"), problem.alias("problem"))


ABORTS = [(1, ["cm_a eq 2"], []), (2, ["cm_a eq 1"], []), (3, ["cm_a eq 2 and cm_b eq 1"], []), (4, ["card(x) eq 0"], []), (5, ["cm_bad eq 1"], ["cm_bad"]), (6, ["cm_bad ne 1"], ["cm_bad"]), (7, ["cm_bad eq 1 or cm_a eq 1"], ["cm_bad"]), (8, [], [])]
_SEVERITY = ["aborts by default", "ok", "depends", "-", "dead check", "impossible", "suspicious", "-"]


@query("t19_precondition_severity", f"WITH {values('t', 'id, severity', list(zip(range(1, 9), _SEVERITY, strict=True)))} SELECT * FROM t")
def t19(spark: SparkSession, d: str) -> DataFrame:
    from traceframe.operators.sweeps import severity

    aborts = fixture(spark, "id int, conditions array<string>, problems array<string>", ABORTS)
    return severity(aborts, F.create_map(F.lit("cm_a"), F.lit("2")), ["cm_a", "cm_b", "cm_bad"]).select("id", "severity")


@query("t14_difference_to_defaults", "SELECT c_custkey, c_mktsegment AS value FROM customer WHERE lower(c_mktsegment) <> 'machinery'")
def t14(spark: SparkSession, d: str) -> DataFrame:
    held, base = F.create_map(F.lit("segment"), F.col("c_mktsegment")), F.create_map(F.lit("segment"), F.lit("'Machinery'"))
    from traceframe.functions.text import unquoted

    differs = F.map_filter(held, lambda k, v: F.lower(unquoted(v)) != F.lower(unquoted(F.try_element_at(base, k))))
    return table(spark, d, "customer").select("c_custkey", F.explode(differs).alias("key", "value")).select("c_custkey", "value")


@query(
    "t15_config_use",
    """WITH v AS (SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'BUILDING') AS value, c_acctbal <= 0 AS unset, c_nationkey % 5 AS region FROM customer),
    g AS (SELECT value, region, count(*) AS n, count(*) FILTER (unset) AS unset, min(c_custkey) AS example FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value, region) AS place FROM g)
    SELECT CASE WHEN place <= 8 THEN value ELSE 'others' END AS value, CASE WHEN place <= 8 THEN region END AS region, sum(n)::BIGINT AS n, sum(unset)::BIGINT AS unset FROM r GROUP BY 1, 2""",
)
def t15(spark: SparkSession, d: str) -> DataFrame:
    """Values of a setting over all configurations: 8 groups and the rest in one line."""
    from pyspark.sql import Window

    unset = F.col("c_acctbal") <= 0
    v = table(spark, d, "customer").select("c_custkey", F.when(unset, "BUILDING").otherwise(F.col("c_mktsegment")).alias("value"), unset.alias("unset"), (F.col("c_nationkey") % 5).alias("region"))
    g = v.groupBy("value", "region").agg(F.count(F.lit(1)).alias("n"), F.count_if("unset").alias("unset"))
    r = g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value", "region")))
    few = F.col("place") <= 8
    return r.groupBy(F.when(few, F.col("value")).otherwise("others").alias("value"), F.when(few, F.col("region")).alias("region")).agg(F.sum("n").alias("n"), F.sum("unset").alias("unset"))
