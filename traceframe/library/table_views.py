"""Steering, prose checks and graphs over whole tables: T16, T20, T24, T25, T28, T29."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import table
from traceframe.operators import sweeps

_KINDS = "['compile', 'guard', 'read']"
_USES = f"SELECT 'm' || l_suppkey AS module, l_returnflag AS realization, 's' || l_partkey % 5 AS switch, {_KINDS}[l_linenumber % 3 + 1] AS kind FROM lineitem WHERE l_quantity < 12"
_ACTIVE = "SELECT DISTINCT 'm' || l_suppkey AS module, l_returnflag AS realization FROM lineitem WHERE l_tax > 0.05 AND l_suppkey % 3 > 0"


@query(
    "t16_steering_of_suppliers",
    f"""WITH u AS ({_USES}), k AS ({_ACTIVE}), b AS (SELECT module, realization, switch, min(list_position({_KINDS}, kind)) AS r FROM u JOIN k USING (module, realization) GROUP BY 1, 2, 3),
    n AS (SELECT module, count(*) AS need FROM k GROUP BY 1), h AS (SELECT module, switch, count(*) AS have FROM b GROUP BY 1, 2)
    SELECT b.module, b.realization, b.switch, {_KINDS}[r] AS kind, have = need AND need > 1 AS common FROM b JOIN n USING (module) JOIN h ON h.module = b.module AND h.switch = b.switch""",
)
def t16(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers stand for modules, flags for realizations, groups of parts for switches."""
    li = table(spark, d, "lineitem")
    module = F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("module")
    kind = F.get(F.array(F.lit("compile"), F.lit("guard"), F.lit("read")), (F.col("l_linenumber") % 3).cast("int"))
    uses = li.filter("l_quantity < 12").select(module, F.col("l_returnflag").alias("realization"), F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string")).alias("switch"), kind.alias("kind"))
    active = li.filter("l_tax > 0.05 and l_suppkey % 3 > 0").select(module, F.col("l_returnflag").alias("realization")).distinct()
    return sweeps.steering(uses, active)


_KNOWN = "SELECT '01_' || replace(r_name, ' ', '_') AS module, n_name AS realization FROM region JOIN nation ON n_regionkey = r_regionkey"


def _known(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select(F.concat(F.lit("01_"), F.replace("r_name", F.lit(" "), F.lit("_"))).alias("module"), F.col("n_name").alias("realization"))


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """c_custkey, its nation and region (as an identifier), and the name of another nation, of the same region for every second one."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.replace("r_name", F.lit(" "), F.lit("_")).alias("region"))
    other = nation.select(F.col("n_nationkey").alias("other"), F.col("n_name").alias("next"))
    step = F.when(F.col("n_nationkey") % 2 == 0, 5).otherwise(1)
    held = nation.join(region, "n_regionkey").withColumn("other", F.col("n_nationkey") + step).join(other, "other", "left")
    return table(spark, d, "customer").join(held, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "region", "n_name", "next")


_CUSTOMERS = "SELECT c_custkey, replace(r_name, ' ', '_') AS region, n.n_name, m.n_name AS next FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN region ON n.n_regionkey = r_regionkey LEFT JOIN nation m ON m.n_nationkey = n.n_nationkey + CASE WHEN n.n_nationkey % 2 = 0 THEN 5 ELSE 1 END"


@query("t20_messages_of_customers", f"WITH k AS ({_KNOWN}), c AS ({_CUSTOMERS}) SELECT c_custkey AS id, c.next AS named FROM c JOIN k ON k.module = '01_' || region AND k.realization = c.next WHERE c.next <> n_name")
def t20(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a nation that name another one: an issue if that is another of the same region."""
    told = _customers(spark, d).select(F.col("c_custkey").alias("id"), F.concat(F.lit("01_"), "region").alias("module"), F.col("n_name").alias("realization"), F.concat_ws(" ", F.lit("not for"), "n_name", F.lit("but for"), "next").alias("message"))
    return sweeps.message_issues(told, _known(spark, d))


@query(
    "t24_pointers_of_documents",
    """WITH f AS (SELECT DISTINCT 'modules/' || source || '/' || lang || '.md' AS path FROM documents WHERE doc_id % 2 = 0 AND lang <> 'en' UNION SELECT DISTINCT source || '/en.md' FROM documents),
    s AS (SELECT source || '/x' AS path, doc_id AS line, source || '/' || lang || '.md' AS pointer FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
    SELECT * FROM s WHERE pointer NOT IN (SELECT path FROM f WHERE path IS NOT NULL) AND 'modules/' || pointer NOT IN (SELECT path FROM f WHERE path IS NOT NULL)""",
)
def t24(spark: SparkSession, d: str) -> DataFrame:
    """Every document points to a file of its source and language; half of them make those of other languages exist, below modules/."""
    docs = table(spark, d, "documents").filter("source is not null and lang is not null")
    path = F.concat("source", F.lit("/"), "lang", F.lit(".md"))
    files = docs.filter("doc_id % 2 = 0 and lang <> 'en'").select(F.concat(F.lit("modules/"), path).alias("path")).union(docs.select(F.concat("source", F.lit("/en.md")))).distinct()
    prose = docs.select(F.concat("source", F.lit("/x")).alias("path"), F.col("doc_id").alias("line"), F.concat(F.lit("see ("), path, F.lit("), and more.")).alias("text"))
    return sweeps.lost_pointers(prose, files)


@query("t25_realizations_of_customers", f"WITH k AS ({_KNOWN}), c AS ({_CUSTOMERS}) SELECT 'p' AS path, c_custkey AS line, lower(region) AS module, next AS realization FROM c WHERE next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.module = '01_' || region AND k.realization = next)")
def t25(spark: SparkSession, d: str) -> DataFrame:
    """Prose sets a customer's region to another nation, which may lie elsewhere."""
    prose = _customers(spark, d).filter("next is not null").select(F.lit("p").alias("path"), F.col("c_custkey").alias("line"), F.concat(F.lit("set "), "region", F.lit(" = '"), "next", F.lit("'; x = 1")).alias("text"))
    return sweeps.unknown_realizations(prose, _known(spark, d))


_EDGES = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE (c_nationkey * 7 + s_nationkey * 3) % 23 = 0 AND c_nationkey <> s_nationkey"
_REACH = f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Nations of customers and of suppliers that serve them, where a rule lets them."""
    t = lambda name: table(spark, d, name)
    lines = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = lines.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    return pairs.select("src", "dst").filter("(src * 7 + dst * 3) % 23 = 0 and src <> dst").distinct()


@query("t28_nations_reached", f"{_REACH} SELECT src, dst FROM r")
def t28(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.reachable(_edges(spark, d))


@query("t29_components_of_nations", f"{_REACH} SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src")
def t29(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.strong_components(_edges(spark, d))
