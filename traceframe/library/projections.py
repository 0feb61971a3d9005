"""Projections and scalar functions: F01-F25, set operations U01-U08, sorting O01-O12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import text as T
from traceframe.library.common import fixture, table, values
from traceframe.operators.search import CANDIDATES_FILTERED

_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("f01_shorten", f"SELECT doc_id, CASE WHEN length({_FLAT}) > 60 THEN left({_FLAT}, 59) || '…' ELSE {_FLAT} END AS short FROM documents")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 60).alias("short"))


@query("f02_first_sentence", "SELECT doc_id, CASE WHEN regexp_extract(text, '^(.+?[.!?])(\\s|$)', 1) = '' THEN text ELSE regexp_extract(text, '^(.+?[.!?])(\\s|$)', 1) END AS sentence FROM documents")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query(
    "f03_doc_prose",
    """SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'A')), lambda x: trim(substr(x, 2))), lambda x: x <> '' AND NOT regexp_matches(x, '^n')), ' ') AS prose FROM documents""",
)
def f03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.prose(F.col("text"), "A", "^n").alias("prose"))


@query(
    "f04_header",
    """SELECT o_orderkey, concat_ws(chr(10), 'Order ' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finished' END, 'Uses: ' || (SELECT string_agg(l_partkey::VARCHAR, ', ' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 3)) AS header FROM orders""",
)
def f04(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    uses = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ", ").alias("uses"))
    header = F.concat_ws("\n", F.concat(F.lit("Order "), "o_orderkey"), F.when(F.col("o_orderstatus") == "F", "finished"), F.concat(F.lit("Uses: "), "uses"))
    return table(spark, d, "orders").join(uses, "o_orderkey", "left").select("o_orderkey", header.alias("header"))


@query("f05_first_description", "SELECT p_brand, arg_min(p_name, p_partkey) AS description FROM part WHERE p_size > 10 AND p_name <> '' GROUP BY p_brand")
def f05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size > 10 and p_name <> ''").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("description"))


@query("f06_embed_text", "SELECT doc_id, regexp_replace(source || chr(10) || text, '[ \\t]+', ' ', 'g') AS squeezed FROM documents")
def f06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.squeezed(F.col("source"), F.col("text")).alias("squeezed"))


@query("f08_content_key", "SELECT doc_id, sha1('m1|' || left(regexp_replace(source || chr(10) || text, '[ \\t]+', ' ', 'g'), 1000)) AS key FROM documents")
def f08(spark: SparkSession, d: str) -> DataFrame:
    seen = T.visible(T.squeezed(F.col("source"), F.col("text")))
    return table(spark, d, "documents").select("doc_id", T.content_key(F.lit("m1"), seen).alias("key"))


HEADERS = [(1, "core\nDeclaration\nUses: a, b", ["p_a", "p_b"]), (2, "modules/x", []), (3, "Uses: z", ["q"])]


@query("f09_index_title", f"WITH {values('t', 'id, header, names', HEADERS)} SELECT id, trim(array_to_string(list_filter(string_split(header, chr(10)), lambda x: NOT starts_with(x, 'Uses:')), chr(10)) || ' ' || array_to_string(names, ' ')) AS title FROM t")
def f09(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, header string, names array<string>", HEADERS).select("id", T.index_title(F.col("header"), F.col("names")).alias("title"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_DISTINCT = "list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query("f10_query_terms", f"WITH t AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: NOT list_contains({_STOPS}, lower(w))) AS w FROM benchmark) SELECT item_id, {_DISTINCT.format(x='w')} AS terms FROM t")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.query_terms(F.col("text")).alias("terms"))


@query("f11_identifiers", f"WITH t AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z]')) AS w FROM conversations) SELECT conv_id, turn, {_DISTINCT.format(x='w')} AS names FROM t")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.identifiers(F.col("text")).alias("names"))


QUERIES = [(1, "why is k_level 9 in v_stock(t)"), (2, "no names here"), (3, "p_a_b and x_ y")]


@query("f12_prefixed_identifiers", f"WITH {values('t', 'id, text', QUERIES)} SELECT id, regexp_extract_all(text, '[A-Za-z]\\w*_\\w+') AS names FROM t")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, text string", QUERIES).select("id", T.prefixed_identifiers(F.col("text")).alias("names"))


_NUM = "'^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'"
COMPARISONS = [
    (1, "9", "eq", "9.0"), (2, "9", "ne", "9"), (3, "'on'", "eq", '"ON"'), (4, "on", "lt", "off"), (5, "2005", "le", "2005"), (6, "1d", "eq", "1"), (7, None, "eq", "1"),
    (8, "3", "gt", "10"), (9, " x ", "ne", "y"), (10, "1_0", "eq", "10"), (11, ".5", "ge", "5e-1"),
]
_BARE = "regexp_replace(trim({0}), '^[\"'']+|[\"'']+$', '', 'g')"


@query(
    "f13_compare",
    f"""WITH {values('t', 'id, l, op, r', COMPARISONS)}, b AS (SELECT id, op, {_BARE.format('l')} AS l, {_BARE.format('r')} AS r FROM t),
    n AS (SELECT *, CASE WHEN regexp_matches(l, {_NUM}) THEN TRY_CAST(l AS DOUBLE) END AS x, CASE WHEN regexp_matches(r, {_NUM}) THEN TRY_CAST(r AS DOUBLE) END AS y FROM b)
    SELECT id, CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE op WHEN 'eq' THEN x = y WHEN 'ne' THEN x <> y WHEN 'lt' THEN x < y WHEN 'le' THEN x <= y WHEN 'gt' THEN x > y WHEN 'ge' THEN x >= y END
      WHEN op = 'eq' THEN lower(l) = lower(r) WHEN op = 'ne' THEN lower(l) <> lower(r) END AS holds FROM n""",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, l string, op string, r string", COMPARISONS).select("id", T.compare(F.col("l"), F.col("op"), F.col("r")).alias("holds"))


@query("f14_unquoted", f"WITH {values('t', 'id, l, op, r', COMPARISONS)} SELECT id, {_BARE.format('l')} AS bare FROM t")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, l string, op string, r string", COMPARISONS).select("id", T.unquoted(F.col("l")).alias("bare"))


MODULES = [("14_Fuel_mix", w) for w in ("14", "Fuel_mix", "14_fuel_mix", "4", "fuel")] + [("03_trade", w) for w in ("3", "03", "trade ", "1")]


@query(
    "f15_module_match",
    f"""WITH {values('t', 'module, wanted', MODULES)}, l AS (SELECT *, lower(module) AS m, lower(trim(wanted)) AS w FROM t)
    SELECT module, wanted, m = w OR substr(m, instr(m, '_') + 1) = w OR split_part(m, '_', 1) = w OR (regexp_matches(w, '^\\d$') AND split_part(m, '_', 1) = lpad(w, 2, '0')) AS matches FROM l""",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "module string, wanted string", MODULES).withColumn("matches", T.module_matches(F.col("module"), F.col("wanted")))


@query("f16_region_label", "SELECT doc_id, coalesce(nullif(regexp_replace(source, '^src', ''), ''), source) AS region FROM documents")
def f16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(F.regexp_replace("source", "^src", ""), F.lit("")), "source").alias("region"))


@query("f17_side_predicate", "SELECT source, count(*) FILTER (NOT contains(source, '1')) AS counted, count(*) AS n FROM documents GROUP BY source")
def f17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(~F.contains("source", F.lit("1"))).alias("counted"), F.count(F.lit(1)).alias("n"))


STATED = [(1, "`25 %`", "0.25"), (2, "1.5", "1.5"), (3, "Quick.", "quick"), (4, "5", "6"), (5, "25", "0.25"), (6, "0.3", "1.3"), (7, "table", "tableOfRates"), (8, "x", "y")]
_NV = """CASE WHEN v IS NOT NULL THEN v::VARCHAR ELSE lower(bare) END"""


@query(
    "f18_normal_value",
    f"""WITH {values('t', 'id, s, a', STATED)}, b AS (SELECT id, regexp_replace(trim(s), '^["''`.,;:()]+|["''`.,;:()]+$', '', 'g') AS bare FROM t),
    p AS (SELECT *, regexp_replace(bare, '\\s*%$', '') AS part FROM b),
    n AS (SELECT *, round(CASE WHEN regexp_matches(part, {_NUM}) THEN TRY_CAST(part AS DOUBLE) END / CASE WHEN bare LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END, 9) AS v FROM p) SELECT id, {_NV} AS value FROM n""",
)
def f18(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, s string, a string", STATED).select("id", T.normal_value(F.col("s")).alias("value"))


@query(
    "f19_same_value",
    f"""WITH {values('t', 'id, s, a', STATED)}, n AS (SELECT *, CASE WHEN regexp_matches(s, {_NUM}) THEN TRY_CAST(s AS DOUBLE) END AS x, CASE WHEN regexp_matches(a, {_NUM}) THEN TRY_CAST(a AS DOUBLE) END AS y FROM t)
    SELECT id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN abs(y - x) < 1e-9 OR abs(y / 100 - x) < 1e-9 OR abs(y - 1 - x) < 1e-9 OR abs(y * 100 - x) < 1e-9 ELSE starts_with(a, s) OR starts_with(s, a) END AS same FROM n""",
)
def f19(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, s string, a string", STATED).select("id", T.same_value(F.col("s"), F.col("a")).alias("same"))


@query("f20_allowed_value", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[1-3]\\d?') AS allowed FROM part")
def f20(spark: SparkSession, d: str) -> DataFrame:
    pattern = "Brand#[1-3]\\d?"  # checked on the driver before use; a pattern that does not compile lets all values pass
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").rlike(f"^(?:{pattern})$").alias("allowed"))


SNIPPETS = [(1, "p_x.l(t) = 1", "p_x"), (2, "p_x(t) = 1", "p_x"), (3, "v_y.scale = 3", "v_y"), (4, "v_y.low = 3", "v_y"), (5, "P_X.M = 1", "p_x")]


@query("f21_start_value", f"WITH {values('t', 'id, code, name', SNIPPETS)} SELECT id, regexp_matches(lower(code), '\\b' || lower(name) || '\\.(l|m|scale)\\b') AS start_value FROM t")
def f21(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit(r"\b\Q"), F.lower("name"), F.lit(r"\E\.(l|m|scale)\b"))
    return fixture(spark, "id int, code string, name string", SNIPPETS).select("id", F.regexp_like(F.lower("code"), name).alias("start_value"))


@query("f22_phase_class", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'equation' WHEN event_type IN ('view', 'signup') THEN 'between solves' ELSE 'setup' END AS class FROM events")
def f22(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "equation").when(F.col("event_type").isin("view", "signup"), "between solves").otherwise("setup")
    return table(spark, d, "events").select("event_id", kind.alias("class"))


@query("f23_search_filters", f"SELECT doc_id FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT {CANDIDATES_FILTERED}) WHERE lower(lang) = 'en' AND lower(source) LIKE 'src1%'")
def f23(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source").orderBy(F.desc("n_chars"), "doc_id").limit(CANDIDATES_FILTERED)
    return top.filter((F.lower("lang") == "en") & F.lower("source").startswith("src1")).select("doc_id")


@query("f24_default_value", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), json_extract_string('{\"z\": \"0\"}', '$.k'), 'unset') AS value FROM events")
def f24(spark: SparkSession, d: str) -> DataFrame:
    cells, defaults = F.from_json("props", "map<string,string>"), F.create_map(F.lit("z"), F.lit("0"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(cells, F.lit("k")), F.try_element_at(defaults, F.lit("k")), F.lit("unset")).alias("value"))


@query("f25_markdown_cell", "SELECT doc_id, left(replace(replace(text, '|', '\\|'), chr(10), ' '), 140) AS cell FROM documents")
def f25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.cell(F.col("text")).alias("cell"))


@query("f27_squeeze", "SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS squeezed FROM documents")
def f27(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace("text", r"\s+", "")).alias("squeezed"))


@query("u01_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u02_vocabulary_union", "SELECT name, count(*) AS sources FROM (SELECT DISTINCT lower(p_brand) AS name, 1 AS s FROM part UNION SELECT DISTINCT lower(n_name), 2 FROM nation) GROUP BY name")
def u02(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.lower("p_brand").alias("name"), F.lit(1).alias("s"))
    b = table(spark, d, "nation").select(F.lower("n_name").alias("name"), F.lit(2).alias("s"))
    return a.union(b).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("sources"))


_OLD, _NEW = "l_quantity < 40", "l_quantity > 10"


@query(
    "u03_multiset_difference",
    f"""SELECT 'gone' AS side, * FROM (SELECT l_partkey, l_returnflag FROM lineitem WHERE {_OLD} EXCEPT ALL SELECT l_partkey, l_returnflag FROM lineitem WHERE {_NEW})
    UNION ALL SELECT 'new', * FROM (SELECT l_partkey, l_returnflag FROM lineitem WHERE {_NEW} EXCEPT ALL SELECT l_partkey, l_returnflag FROM lineitem WHERE {_OLD})""",
)
def u03(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    old, new = (items.filter(c).select("l_partkey", "l_returnflag") for c in (_OLD, _NEW))
    return old.exceptAll(new).select(F.lit("gone").alias("side"), "*").unionAll(new.exceptAll(old).select(F.lit("new").alias("side"), "*"))


@query("u04_key_sets", "SELECT 'only customers' AS kind, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'both', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders)")
def u04(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.subtract(b).select(F.lit("only customers").alias("kind"), "k").unionAll(a.intersect(b).select(F.lit("both").alias("kind"), "k"))


@query("u05_text_union", "SELECT DISTINCT text FROM (SELECT unnest([lang, source]) AS text FROM documents UNION ALL SELECT event_type FROM events UNION ALL SELECT role FROM conversations UNION ALL SELECT p_type FROM part)")
def u05(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, "documents").select(F.explode(F.array("lang", "source")).alias("text")), table(spark, d, "events").select("event_type"), table(spark, d, "conversations").select("role"), table(spark, d, "part").select("p_type")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


@query("u06_union_of_findings", "SELECT 'late' AS finding, l_orderkey AS k FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'poor', c_custkey FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'dear', o_orderkey FROM orders WHERE o_totalprice > 400000")
def u06(spark: SparkSession, d: str) -> DataFrame:
    find = lambda t, k, c, n: table(spark, d, t).filter(c).select(F.lit(n).alias("finding"), F.col(k).alias("k"))
    return find("lineitem", "l_orderkey", "l_quantity > 49", "late").unionByName(find("customer", "c_custkey", "c_acctbal < -900", "poor")).unionByName(find("orders", "o_orderkey", "o_totalprice > 400000", "dear"))


@query("u07_edges_of_nodes", "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey < 12 AND c_nationkey < 12")
def u07(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return s.join(c, s.s_suppkey == c.c_custkey).filter("s_nationkey < 12 and c_nationkey < 12").select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()


@query("o03_stable_fused_order", "WITH r AS (SELECT doc_id, n_chars // 500 AS score, 1 AS ranking, row_number() OVER (ORDER BY doc_id) AS rank FROM documents) SELECT doc_id, row_number() OVER (ORDER BY score DESC, ranking, rank) AS place FROM r")
def o03(spark: SparkSession, d: str) -> DataFrame:
    """Ties keep the order of the first ranking in which an id stands, then its rank there."""
    ranked = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 500).alias("score"), F.lit(1).alias("ranking"), F.row_number().over(Window.orderBy("doc_id")).alias("rank"))
    return ranked.select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "ranking", "rank")).cast("bigint").alias("place"))


@query("o05_ordered_links", "SELECT * FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderstatus, o_orderpriority, o_orderkey LIMIT 10)")
def o05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderstatus", "o_orderpriority", "o_orderkey").limit(10)


@query(
    "o06_inactive_share",
    """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS inactive FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, inactive ORDER BY event_id) AS k FROM e),
    a AS (SELECT user_id, least(10, count(*) FILTER (NOT inactive)) AS active FROM e GROUP BY 1) SELECT user_id, event_id, inactive FROM r JOIN a USING (user_id) WHERE k <= CASE WHEN inactive THEN greatest(3, least(5, 10 - active)) ELSE 10 END""",
)
def o06(spark: SparkSession, d: str) -> DataFrame:
    """At most 10 active entries, and of the inactive at most max(3, min(5, what the active leave))."""
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("inactive"))
    ranked = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "inactive").orderBy("event_id")))
    active = e.groupBy("user_id").agg(F.least(F.lit(10), F.count_if(~F.col("inactive"))).alias("active"))
    cap = F.when(F.col("inactive"), F.greatest(F.lit(3), F.least(F.lit(5), 10 - F.col("active")))).otherwise(10)
    return ranked.join(active, "user_id").filter(F.col("k") <= cap).select("user_id", "event_id", "inactive")


@query("o08_groups_by_count", "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def o08(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint"))


@query("o09_preferred_rows", "SELECT doc_id, source FROM documents ORDER BY contains(source, '9'), source <> 'src0', source, doc_id LIMIT 25")
def o09(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").orderBy(F.contains("source", F.lit("9")), F.col("source") != "src0", "source", "doc_id").limit(25)


@query("o12_similar_names", "SELECT p_type FROM (SELECT DISTINCT p_type FROM part WHERE p_type ILIKE '%a_d%' OR p_type ILIKE '%o_o%') ORDER BY p_type LIMIT 10")
def o12(spark: SparkSession, d: str) -> DataFrame:
    """Names that contain the text without regard to case; an underscore stands for any character."""
    return table(spark, d, "part").filter(F.col("p_type").ilike("%a_d%") | F.col("p_type").ilike("%o_o%")).select("p_type").distinct().orderBy("p_type").limit(10)
