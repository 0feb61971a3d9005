"""Evaluation and tooling E03-E13, S14, S15, S18-S22."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import fixture, table, values
from traceframe.operators import quality as Q
from traceframe.plans.sizing import bounded_broadcast

OLD_META, NEW_META = [("root", "a"), ("commit", "1"), ("gone", "x")], [("root", "a"), ("commit", "2"), ("fresh", "y")]


@query("e03_meta_diff", f"WITH {values('o', 'key, value', OLD_META)}, {values('n', 'key, value', NEW_META)} SELECT coalesce(o.key, n.key) AS key, o.value AS old, n.value AS new FROM o FULL JOIN n ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value")
def e03(spark: SparkSession, d: str) -> DataFrame:
    meta = lambda rows: fixture(spark, "key string, value string", rows)
    return Q.meta_diff(meta(OLD_META), meta(NEW_META))


@query("e04_table_diff", "SELECT *, 'gone' AS side FROM (SELECT l_orderkey, l_tax FROM lineitem WHERE l_quantity < 30 EXCEPT ALL SELECT l_orderkey, l_tax FROM lineitem WHERE l_quantity > 5) UNION ALL SELECT *, 'new' FROM (SELECT l_orderkey, l_tax FROM lineitem WHERE l_quantity > 5 EXCEPT ALL SELECT l_orderkey, l_tax FROM lineitem WHERE l_quantity < 30)")
def e04(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return Q.table_diff(li.filter("l_quantity < 30").select("l_orderkey", "l_tax"), li.filter("l_quantity > 5").select("l_orderkey", "l_tax"))


@query(
    "e05_keyed_diff",
    """WITH a AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'gone' WHEN a.o_orderkey IS NULL THEN 'new' ELSE 'changed' END AS kind,
    CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN [] ELSE list_filter([CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.price IS DISTINCT FROM b.price THEN 'price' END], lambda x: x IS NOT NULL) END AS changed
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.status IS DISTINCT FROM b.status OR a.price IS DISTINCT FROM b.price""",
)
def e05(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.filter(k % 3 != 0).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    b = o.filter(k % 4 != 0).select("o_orderkey", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("price"))
    return Q.keyed_diff(a, b, ["o_orderkey"])


@query("e06_symbol_diff", "SELECT 'gone' AS side, name FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 3 EXCEPT SELECT p_name FROM part WHERE p_size > 48) UNION ALL SELECT 'new', name FROM (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 48 EXCEPT SELECT p_name FROM part WHERE p_size < 3)")
def e06(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    a, b = (p.filter(c).select(F.col("p_name").alias("name")) for c in ("p_size < 3", "p_size > 48"))
    return a.subtract(b).select(F.lit("gone").alias("side"), "name").unionAll(b.subtract(a).select(F.lit("new").alias("side"), "name"))


_REF, _IDX = "l_quantity > 10", "l_quantity < 45"


@query(
    "e07_agreement",
    f"""WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, bool_or({_REF}) AS r, bool_or({_IDX}) AS i FROM lineitem WHERE {_REF} OR {_IDX} GROUP BY 1, 2, 3)
    SELECT l_returnflag, count(*) FILTER (r) AS entries, count(*) FILTER (i) AS found, count(*) FILTER (r AND i) AS hits, round(count(*) FILTER (r AND i) / count(*) FILTER (r), 6) AS recall, round(count(*) FILTER (r AND i) / count(*) FILTER (i), 6) AS precision FROM b GROUP BY ROLLUP (l_returnflag)""",
)
def e07(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return Q.agreement(li.filter(_REF), li.filter(_IDX), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


ROLES = [("declared", "declared"), ("defined", "equation"), ("assigned", "assigned"), ("impl-asn", "assigned"), ("ref", "read"), ("control", "read"), ("ref", "equation")]
SEEN = [(1, "ref", "read"), (2, "ref", "assigned"), (3, "defined", "equation"), (4, "ref", "equation"), (5, "control", "declared")]


@query("e08_role_compatibility", f"WITH {values('r', 'reftype, role', ROLES)}, {values('s', 'id, reftype, role', SEEN)} SELECT id, EXISTS (SELECT 1 FROM r WHERE r.reftype = s.reftype AND r.role = s.role) AS agrees FROM s")
def e08(spark: SparkSession, d: str) -> DataFrame:
    fits = fixture(spark, "reftype string, role string", ROLES).withColumn("fits", F.lit(True))
    return fixture(spark, "id int, reftype string, role string", SEEN).join(bounded_broadcast(fits), ["reftype", "role"], "left").select("id", F.coalesce("fits", F.lit(False)).alias("agrees"))


@query("e11_output_sizes", "SELECT page_id, length(html) AS chars, length(html) - length(replace(html, chr(10), '')) + 1 AS lines, (length(html) // 2)::BIGINT AS tokens FROM pages")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return Q.output_sizes(table(spark, d, "pages"), "page_id", "html")


@query("e13_overridden_totals", "SELECT coalesce(CASE WHEN doc_id % 10 = 0 THEN 1 END, toxic) AS toxic, count(*) AS n, round(avg(quality), 6) AS quality FROM labels GROUP BY 1")
def e13(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    over = labels.filter("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("toxic")).distinct()
    return Q.with_overrides(labels, over, "doc_id", ["toxic"]).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


OLD_M, NEW_M = [("bm25", 0.7, 0.5), ("hybrid", 0.8, 0.69)], [("bm25", 0.71, 0.5), ("hybrid", 0.8, 0.68)]


@query("s14_promotion_gate", f"WITH {values('o', 'mode, recall, mrr', OLD_M)}, {values('n', 'mode, recall, mrr', NEW_M)} SELECT mode, n.recall >= o.recall AND n.mrr >= o.mrr AS fine FROM o JOIN n USING (mode)")
def s14(spark: SparkSession, d: str) -> DataFrame:
    m = lambda rows: fixture(spark, "mode string, recall double, mrr double", rows)
    o = m(OLD_M).select("mode", F.col("recall").alias("r"), F.col("mrr").alias("q"))
    return m(NEW_M).join(o, "mode").select("mode", ((F.col("recall") >= F.col("r")) & (F.col("mrr") >= F.col("q"))).alias("fine"))


REF = ["12 p_x PARAM ref 100 20 3 0 4 modules/a.gms", "13 p_y PARAM strange 1 2 3 0 1 x.gms", "short line", "14 q_z EQU defined 7 x 1 0 2 b.gms", "15 v_w VAR assigned 9 30 1 0 2 modules/c d.gms"]


@query(
    "s19_reference_file",
    f"""WITH {values('t', 'value', [(x,) for x in REF])}, p AS (SELECT regexp_extract(value, '^(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+(\\S+)\\s+\\S+\\s+\\S+\\s+\\S+\\s+(.*)$', ['id', 'name', 'type', 'reftype', 'global', 'line', 'path']) AS f FROM t)
    SELECT f.name AS name, f.reftype AS reftype, f.line::INT AS line, f.path AS path FROM p WHERE f.reftype IN ('declared', 'defined', 'assigned', 'impl-asn', 'ref', 'control') AND regexp_matches(f.line, '^\\d+$')""",
)
def s19(spark: SparkSession, d: str) -> DataFrame:
    from traceframe.sources.readers import reference_entries

    return reference_entries(fixture(spark, "value string", [(x,) for x in REF])).select("name", "reftype", "line", "path")


LISTING = [(1, "    10  a = 1;"), (2, "    11  b = 2;"), (3, "    10  later"), (4, "no number")]


@query("s20_listing", f"WITH {values('t', 'n, value', LISTING)} SELECT regexp_extract(value, '^ *(\\d{{1,9}})  (.*)$', 1)::INT AS line, arg_min(regexp_extract(value, '^ *(\\d{{1,9}})  (.*)$', 2), n) AS code FROM t WHERE regexp_matches(value, '^ *\\d{{1,9}}  ') GROUP BY 1")
def s20(spark: SparkSession, d: str) -> DataFrame:
    from traceframe.sources.readers import listing_lines

    return listing_lines(fixture(spark, "n int, value string", LISTING))


LOG = [
    (1, '{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "search"}, {"type": "text", "text": "x"}]}, "usage": {"input_tokens": 3, "output_tokens": 1}}'),
    (1, '{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "open"}]}, "usage": {"input_tokens": 5, "output_tokens": 2}}'),
    (1, '{"type": "result", "total_cost_usd": 0.5, "num_turns": 3}'), (2, '{"type": "result", "total_cost_usd": 0.1, "num_turns": 1}'), (2, "not json"),
]


@query(
    "s21_event_log",
    f"""WITH {values('t', 'run, value', LOG)}, j AS (SELECT run, value::JSON AS v FROM t WHERE json_valid(value)),
    c AS (SELECT run, unnest(from_json(v->'$.message.content', '[{{"type": "VARCHAR", "name": "VARCHAR"}}]')) AS x FROM j WHERE v->>'$.type' = 'assistant'),
    k AS (SELECT run, count(*) AS calls, list_sort(list(DISTINCT x.name)) AS tools FROM c WHERE x.type = 'tool_use' GROUP BY 1)
    SELECT run, coalesce(any_value(calls), 0) AS calls, coalesce(any_value(tools), []) AS tools, max((v->>'$.total_cost_usd')::DOUBLE) AS cost, max((v->>'$.num_turns')::INT) AS turns,
    sum((v->>'$.usage.input_tokens')::BIGINT) AS input_tokens, sum((v->>'$.usage.output_tokens')::BIGINT) AS output_tokens FROM j LEFT JOIN k USING (run) GROUP BY 1""",
)
def s21(spark: SparkSession, d: str) -> DataFrame:
    return Q.event_log(fixture(spark, "run int, value string", LOG))
