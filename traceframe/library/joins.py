"""Joins J01-J28."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import LINES_SQL, documents_lines, fixture, table, values
from traceframe.operators import joins as J
from traceframe.operators import settings as S
from traceframe.plans.sizing import bounded_broadcast


@query("j01_chunk_vector", "SELECT doc_id, lang, label, round(embedding[1]::DOUBLE, 6) AS first FROM documents JOIN embeddings ON doc_id = vec_id")
def j01(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return table(spark, d, "documents").select("doc_id", "lang").join(v, "doc_id").select("doc_id", "lang", "label", F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


@query("j02_vocabulary_semi", "SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations) WHERE w IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) FROM benchmark) GROUP BY ALL")
def j02(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t: F.explode(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))).alias("w")
    vocabulary = table(spark, d, "benchmark").select(words(F.col("text"))).distinct()
    tokens = table(spark, d, "conversations").select("conv_id", "turn", words(F.col("text")))
    return tokens.join(vocabulary, "w", "left_semi").groupBy("conv_id", "turn", "w").agg(F.count(F.lit(1)).alias("n"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines: from each line that starts with A to the line before the next."""
    lines = documents_lines(spark, d)
    by = Window.partitionBy("doc_id").orderBy("n")
    starts = lines.withColumn("last", F.max("n").over(Window.partitionBy("doc_id"))).filter("line LIKE 'A%'")
    return starts.select("doc_id", F.col("n").alias("s"), F.coalesce(F.lead("n").over(by) + 1, F.col("last")).alias("e"), F.left("line", F.lit(8)).alias("name"))


_SPANS = f"""{LINES_SQL}, spans AS (SELECT doc_id, n AS s, coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY n) + 1, last) AS e, left(line, 8) AS name
  FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS last FROM lines) WHERE line LIKE 'A%')"""


@query("j03_interval_first_match", f"WITH {_SPANS} SELECT l.doc_id, n, arg_min(name, s) AS name FROM lines l JOIN spans p ON l.doc_id = p.doc_id AND n BETWEEN s AND e GROUP BY 1, 2")
def j03(spark: SparkSession, d: str) -> DataFrame:
    return J.first_span(documents_lines(spark, d), _spans(spark, d), "doc_id", "n", "s", "e", F.col("s"), "name", ["doc_id", "n"])


@query("j04_interval_semi", f"WITH {_SPANS} SELECT doc_id, n FROM lines l WHERE EXISTS (SELECT 1 FROM spans p WHERE p.doc_id = l.doc_id AND n BETWEEN s AND e)")
def j04(spark: SparkSession, d: str) -> DataFrame:
    lines, spans = documents_lines(spark, d).select("doc_id", "n"), _spans(spark, d).select(F.col("doc_id").alias("p"), "s", "e")
    return lines.join(spans, (lines.doc_id == spans.p) & lines.n.between(spans.s, spans.e), "left_semi")


@query("j05_interval_any", "SELECT o_orderkey, min(l_linenumber) AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY 1")
def j05(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    hit = o.join(li, (o.o_orderkey == li.l_orderkey) & li.l_shipdate.between(o.o_orderdate, o.o_orderdate + F.expr("INTERVAL 30 DAY")))
    return hit.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("line"))


@query("j06_tightest_interval", f"WITH {_SPANS} SELECT doc_id, n, s, e FROM (SELECT l.doc_id, n, s, e, row_number() OVER (PARTITION BY l.doc_id, n ORDER BY e - s, s) AS k FROM lines l JOIN spans p ON l.doc_id = p.doc_id AND n BETWEEN s AND e) WHERE k = 1")
def j06(spark: SparkSession, d: str) -> DataFrame:
    hit = J.interval_join(documents_lines(spark, d), _spans(spark, d), "doc_id", "n", "s", "e", bin_width=256)
    w = Window.partitionBy("doc_id", "n").orderBy(F.col("e") - F.col("s"), "s")
    return hit.withColumn("k", F.row_number().over(w)).filter("k = 1").select("doc_id", "n", "s", "e")


@query("j07_members_of_interval", f"WITH {_SPANS} SELECT p.doc_id, s, list(length(line) ORDER BY n) AS sizes FROM spans p JOIN lines l ON l.doc_id = p.doc_id AND n BETWEEN s AND e GROUP BY 1, 2")
def j07(spark: SparkSession, d: str) -> DataFrame:
    hit = J.interval_join(documents_lines(spark, d), _spans(spark, d), "doc_id", "n", "s", "e")
    return hit.groupBy("doc_id", "s").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.length("line").alias("size")))), lambda x: x["size"]).alias("sizes"))


@query("j08_equal_but_for_case", "SELECT DISTINCT n_name, count(*) AS n FROM nation JOIN (SELECT upper(n_name) AS u FROM nation) ON lower(n_name) = lower(u) GROUP BY 1")
def j08(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_name")
    u = n.select(F.upper("n_name").alias("u"))
    return n.join(u, F.lower("n_name") == F.lower("u")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j09_as_of_self",
    "SELECT a.event_id, (SELECT arg_max(b.event_type, {'t': b.ts, 'i': b.event_id}) FROM events b WHERE b.user_id = a.user_id AND b.ts < a.ts) AS last_event_type FROM events a",
)
def j09(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier event of the same user; of events at one moment the one with the largest id."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    latest = e.groupBy("user_id", "ts").agg(F.max_by("event_type", "event_id").alias("event_type"))
    return J.as_of(e.drop("event_type"), latest, "user_id", "ts", "event_type").select("event_id", "last_event_type")


@query("j10_equi_to_owner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def j10(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_custkey").join(c, "o_custkey").select("o_orderkey", "c_name")


@query("j11_left_with_default", "SELECT c_custkey, coalesce(p, '') AS priority FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j11(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    return table(spark, d, "customer").join(first, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit("")).alias("priority"))


@query(
    "j12_source_of_input",
    "SELECT DISTINCT a.s_nationkey AS module, a.s_suppkey % 20 AS name, coalesce((SELECT min(b.s_nationkey)::VARCHAR FROM supplier b WHERE b.s_suppkey % 20 = a.s_suppkey % 20 AND b.s_acctbal > 0 AND b.s_nationkey <> a.s_nationkey), '?') AS source FROM supplier a WHERE a.s_acctbal <= 0",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("module"), (F.col("s_suppkey") % 20).alias("name"), "s_acctbal")
    wants, gives = s.filter("s_acctbal <= 0").select("module", "name").distinct(), s.filter("s_acctbal > 0").select(F.col("module").alias("giver"), "name").distinct()
    hit = wants.join(gives, (wants.name == gives.name) & (wants.module != gives.giver), "left")
    return hit.groupBy(wants.module, wants.name).agg(F.coalesce(F.min("giver").cast("string"), F.lit("?")).alias("source"))


@query(
    "j13_consumers_of_output",
    "SELECT a.module, a.name, list_sort(list(DISTINCT b.module)) AS consumers FROM (SELECT DISTINCT s_nationkey AS module, s_suppkey % 20 AS name FROM supplier WHERE s_acctbal > 0) a JOIN (SELECT DISTINCT s_nationkey AS module, s_suppkey % 20 AS name FROM supplier WHERE s_acctbal <= 0) b ON a.name = b.name AND a.module <> b.module GROUP BY 1, 2",
)
def j13(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("module"), (F.col("s_suppkey") % 20).alias("name"), "s_acctbal")
    out, use = s.filter("s_acctbal > 0").select("module", "name").distinct(), s.filter("s_acctbal <= 0").select(F.col("module").alias("user"), "name").distinct()
    return out.join(use, "name").filter("module <> user").groupBy("module", "name").agg(F.sort_array(F.collect_set("user")).alias("consumers"))


@query("j14_left_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").filter("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j15_without_documentation", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j15(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("j16_anti_both_ways", "SELECT 'a' AS side, k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_tax > 0.07 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) UNION ALL SELECT 'b', k FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.08 EXCEPT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def j16(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = (li.filter(c).select(F.col("l_partkey").alias("k")).distinct() for c in ("l_tax > 0.07", "l_discount > 0.08"))
    return a.join(b, "k", "left_anti").select(F.lit("a").alias("side"), "k").unionAll(b.join(a, "k", "left_anti").select(F.lit("b").alias("side"), "k"))


NAMES, KNOWN = [("cm_A_",), ("vm_x",), ("p_gone",), ("P_Q",)], [("cm_a",), ("vm_x",), ("p_q",)]


@query("j17_unknown_names", f"WITH {values('p', 'name', NAMES)}, {values('k', 'name', KNOWN)} SELECT name FROM p WHERE lower(name) NOT IN (SELECT lower(name) FROM k) AND regexp_replace(lower(name), '_$', '') NOT IN (SELECT lower(name) FROM k)")
def j17(spark: SparkSession, d: str) -> DataFrame:
    p, k = fixture(spark, "name string", NAMES), fixture(spark, "name string", KNOWN).select(F.lower("name").alias("known"))
    whole = p.join(k, F.lower("name") == F.col("known"), "left_anti")
    return whole.join(k, F.regexp_replace(F.lower("name"), "_$", "") == F.col("known"), "left_anti")


@query("j18_full_outer_by_key", "SELECT coalesce(a.k, b.k) AS k, a.n AS old, b.n AS new FROM (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 20 GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n")
def j18(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = lambda c, name: li.filter(c).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return n("l_quantity < 25", "old").join(n("l_quantity > 20", "new"), "k", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


@query("j19_exact_with_flag", "SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def j19(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("j20_same_statement", f"WITH {LINES_SQL}, s AS (SELECT doc_id, n, coalesce(sum(CASE WHEN line LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM lines) SELECT a.doc_id, a.n, count(*) AS near FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.st = b.st GROUP BY 1, 2")
def j20(spark: SparkSession, d: str) -> DataFrame:
    from traceframe.functions.lines import statement_id

    s = statement_id(documents_lines(spark, d), "doc_id", F.expr("line LIKE '%.'"))
    return s.withColumn("near", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "statement"))).select("doc_id", "n", "near")


@query("j21_nearest_in_band", f"WITH {LINES_SQL} SELECT l.doc_id, l.n, max(m.n) AS before FROM lines l LEFT JOIN lines m ON m.doc_id = l.doc_id AND m.line LIKE 'A%' AND m.n BETWEEN l.n - 60 AND l.n - 1 GROUP BY 1, 2")
def j21(spark: SparkSession, d: str) -> DataFrame:
    from traceframe.functions.lines import nearest_before

    return nearest_before(documents_lines(spark, d), "doc_id", F.expr("line LIKE 'A%'"), 60).select("doc_id", "n", F.col("marked").alias("before"))


@query("j23_theta_pairs", "SELECT r_name, n_name FROM region, nation WHERE length(n_name) < length(r_name) AND n_regionkey <> r_regionkey")
def j23(spark: SparkSession, d: str) -> DataFrame:
    """Both tables have a fixed size (5 and 25 rows)."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return n.join(F.broadcast(r), (F.length("n_name") < F.length("r_name")) & (n.n_regionkey != r.r_regionkey)).select("r_name", "n_name")


@query("j24_hit_of_gold", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'the')")
def j24(spark: SparkSession, d: str) -> DataFrame:
    gold = F.array(F.lit("user"), F.lit("assistant"))
    return table(spark, d, "conversations").filter(F.array_contains(gold, F.col("role")) & F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")


SCENARIOS, ASKED = [("SSP2-NPi",), ("SSP2",), ("NPi",), ("PkBudg",)], [(1, "what does SSP2-NPi set"), (2, "SSP2 and NPi"), (3, "xSSP2 PkBudg650"), (4, "PkBudg?")]


@query(
    "j26_names_in_query",
    f"""WITH {values('s', 'name', SCENARIOS)}, {values('q', 'id, text', ASKED)}, t AS (SELECT id, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS token FROM q)
    SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name) AS place FROM (SELECT DISTINCT id, name FROM t JOIN s ON token = name)""",
)
def j26(spark: SparkSession, d: str) -> DataFrame:
    s, q = fixture(spark, "name string", SCENARIOS), fixture(spark, "id int, text string", ASKED)
    tokens = q.select("id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]+"), F.lit(0))).alias("name"))
    found = tokens.join(bounded_broadcast(s), "name").distinct()
    w = Window.partitionBy("id").orderBy(F.desc(F.length("name")), "name")
    return found.select("id", "name", F.row_number().over(w).cast("bigint").alias("place")).filter("place <= 3")


CELLS = [("f", 2, "A", "base", {"cm_a": "1", "cm_b": "x"}), ("f", 3, "B", "A", {"cm_a": "2"}), ("f", 4, "C", "B", {}), ("f", 6, "A", None, {"cm_a": "9", "description": "again"}), ("f", 7, "E", "A", {}), ("g", 2, "B", "A", {"cm_b": "y"})]


@query(
    "g03_inheritance",
    f"""WITH RECURSIVE {values('t', 'path, line, name, parent, cells', CELLS)}, link AS (SELECT t.path, t.line, (SELECT max(p.line) FROM t p WHERE p.path = t.path AND p.name = t.parent AND p.line < t.line) AS up FROM t),
    chain(path, line, cur, hop) AS (SELECT path, line, line, 0 FROM t UNION ALL SELECT c.path, c.line, l.up, hop + 1 FROM chain c JOIN link l ON l.path = c.path AND l.line = c.cur WHERE l.up IS NOT NULL),
    cell AS (SELECT c.path, c.line, hop, unnest(map_entries(t.cells)) AS e FROM chain c JOIN t ON t.path = c.path AND t.line = c.cur)
    SELECT path, line, e.key AS key, arg_min(e.value, hop) AS value FROM cell GROUP BY 1, 2, 3""",
)
def g03(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, "path string, line int, name string, parent string, cells map<string,string>", CELLS)
    return S.inherit(rows).select("path", "line", F.explode("cells").alias("key", "value"))
