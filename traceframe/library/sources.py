"""Sources, where-used, lineage and coupling over small source trees: S01-S06, S16, T01-T10, T22, T27-T29, C06-C14."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions.text import content_key, visible
from traceframe.library.common import fixture, table, values
from traceframe.operators import chunks as C
from traceframe.operators import lineage as L
from traceframe.operators import source as S
from traceframe.operators import sweeps
from traceframe.operators import uses as U
from traceframe.sources import readers as R

FILES = [
    ("core/presolve.gms", "p_z(t) = p_m(t) * p_a(t) + cm_x;\n* p_m in a comment\n$onText\np_a(t) = p_m(t);\n$offText\nif(cm_x eq 1,\n  p_a(t) = 1;\n);\n"),
    ("core/declarations.gms", 'parameters\n  p_a(t) "with data" / 2020 1 /\n  p_m(t) "without"\n;\nparameter p_z(t) "switch carrier" / %cm_x% /;\nequations q_x(t) "balance";\n'),
    ("modules/12_storage/tank/equations.gms", '$ifthen "%cm_y%" == "on"\nq_x(t)$(cm_x eq 2)..\n  p_z(t) =e= p_a(t);\n$endif\n'),
    ("main.gms", "cm_x = 1; !! def = 1 !! regexp = 1|2\n$setglobal cm_y on\n"),
    ("scripts/plot.R", "# about\nf <- function(p_a) {\n  p_a\n}\n"),
    ("README.md", "intro\n# Use\ntext\n## More\nend\n"),
]


def _files(spark: SparkSession) -> DataFrame:
    return fixture(spark, "path string, text string", FILES)


def _state(spark: SparkSession) -> DataFrame:
    return S.line_state(_files(spark))


def _uses(spark: SparkSession) -> DataFrame:
    state = _state(spark)
    return U.where_used(state, U.declared_symbols(state), S.switches(state).select("name"))


@query("c06_file_chunks")
def c06(spark: SparkSession, d: str) -> DataFrame:
    return C.file_chunks(_files(spark))


@query("l09_line_conditions")
def l09(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark).select("path", "n", "masked", "conditions", "guards", "declared")


_FILE_LINES = f"""{values('f', 'path, text', FILES)}, lines AS (SELECT path, i AS n, string_split(text, chr(10))[i] AS line FROM (SELECT path, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM f))"""


@query(
    "l18_declared_symbols",
    f"""WITH {_FILE_LINES}, w AS (SELECT path, n, line, nullif(regexp_extract(line, '^(parameter|equation)s?', 1), '') AS opens, regexp_extract(line, '^(?:parameters?|equations?)?\\s*([a-z]_\\w+)', 1) AS name, regexp_extract(line, '_\\w+\\(([^)]*)\\)', 1) AS domain FROM lines WHERE path LIKE '%declarations%')
    SELECT name, last_value(opens IGNORE NULLS) OVER (ORDER BY n) AS kind, domain, n AS line FROM w QUALIFY name <> ''""",
)
def l18(spark: SparkSession, d: str) -> DataFrame:
    return U.declared_symbols(_state(spark)).select("name", "kind", "domain", "line")


@query("l20_aborts")
def l20(spark: SparkSession, d: str) -> DataFrame:
    text = "$ifthen %x% == 'a'\n$abort 'bad x'\n$endif\nif(cm_y eq 1,\nabort \"no y\";\n);\n"
    return S.aborts(S.line_state(fixture(spark, "path string, text string", [("core/a.gms", text)])))


@query(
    "c07_switches",
    f"""WITH {_FILE_LINES}, m AS (SELECT n, line, regexp_extract(line, '^\\$setglobal (\\w+) (\\w+)', 1) AS g, regexp_extract(line, '^(\\w+) = ', 1) AS a FROM lines WHERE path = 'main.gms' AND line <> '')
    SELECT CASE WHEN g <> '' THEN g ELSE a END AS name, CASE WHEN g <> '' THEN regexp_extract(line, '^\\$setglobal (\\w+) (\\w+)', 2) ELSE regexp_extract(line, 'def = (\\S+)', 1) END AS value, regexp_extract(line, 'regexp = (\\S+)', 1) AS allowed, n AS line FROM m""",
)
def c07(spark: SparkSession, d: str) -> DataFrame:
    return S.switches(_state(spark)).select("name", "value", "allowed", "line")


_USES = [
    ("p_z", "core/presolve.gms", 1, "assigned"), ("p_m", "core/presolve.gms", 1, "read"), ("p_a", "core/presolve.gms", 1, "read"), ("cm_x", "core/presolve.gms", 1, "read"),
    ("cm_x", "core/presolve.gms", 6, "read"), ("p_a", "core/presolve.gms", 7, "assigned"), ("p_a", "core/declarations.gms", 2, "assigned"), ("p_m", "core/declarations.gms", 3, "declared"),
    ("p_z", "core/declarations.gms", 5, "assigned"), ("cm_x", "core/declarations.gms", 5, "read"), ("q_x", "core/declarations.gms", 6, "declared"),
    ("q_x", "modules/12_storage/tank/equations.gms", 2, "equation"), ("cm_x", "modules/12_storage/tank/equations.gms", 2, "equation"),
    ("p_z", "modules/12_storage/tank/equations.gms", 3, "equation"), ("p_a", "modules/12_storage/tank/equations.gms", 3, "equation"),
    ("cm_y", "modules/12_storage/tank/equations.gms", 1, "read"), ("cm_x", "main.gms", 1, "assigned"), ("cm_y", "main.gms", 2, "read"),
    ("p_a", "scripts/plot.R", 2, "read"), ("p_a", "scripts/plot.R", 3, "read"),
]


@query("t01_where_used", f"WITH {values('t', 'name, path, line, role', _USES)} SELECT * FROM t")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return _uses(spark).select("name", "path", "line", "role")


@query("t03_flags")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return U.flag_rows(S.line_state(fixture(spark, "path string, text string", [("core/a.gms", '$ifthen "%s%" == "b"\n$setglobal cm_flag "YES"\n$endif\n'), ("standalone/x.gms", "$setglobal no 1\n")])))


_STATEMENTS = """stm AS (SELECT l_orderkey AS statement, 'orders' AS path, l_linenumber AS line, 'p' || (l_partkey % 50) AS name, CASE WHEN l_linenumber = 1 THEN 'assigned' ELSE 'read' END AS role FROM lineitem)"""


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """Each order is a statement: its first line's part is assigned, the others are read."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("statement"), F.lit("orders").alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("name"), F.when(F.col("l_linenumber") == 1, "assigned").otherwise("read").alias("role"))


@query(
    "t06_computed_from",
    f"""WITH {_STATEMENTS}, own AS (SELECT DISTINCT statement FROM stm WHERE name = 'p7' AND role = 'assigned'), i AS (SELECT statement, name, min(line) AS line FROM stm WHERE role = 'read' GROUP BY 1, 2)
    SELECT 'orders' AS path, statement, coalesce(inputs, []) AS inputs FROM own LEFT JOIN (SELECT statement, list(name ORDER BY line, name) AS inputs FROM i GROUP BY 1) USING (statement)""",
)
def t06(spark: SparkSession, d: str) -> DataFrame:
    return L.computed_from(_statements(spark, d), "P7")


@query("t07_feeds_into", f"WITH {_STATEMENTS} SELECT name, count(DISTINCT statement) AS statements FROM stm WHERE role = 'assigned' AND name <> 'p7' AND statement IN (SELECT statement FROM stm WHERE name = 'p7' AND role = 'read') GROUP BY 1")
def t07(spark: SparkSession, d: str) -> DataFrame:
    return L.feeds_into(_statements(spark, d), "p7")


@query("t08_in_equations", "SELECT * FROM (VALUES ('modules/12_storage/tank/equations.gms', 'q_x', ['cm_x', 'q_x', 'p_a'])) t(path, equation, members)")
def t08(spark: SparkSession, d: str) -> DataFrame:
    return L.in_equations(_uses(spark), "p_z")


@query("t09_other_reads", f"WITH {_STATEMENTS} SELECT 'orders' AS path, count(DISTINCT statement) AS statements FROM stm WHERE name = 'p7' AND role = 'read' AND statement NOT IN (SELECT statement FROM stm WHERE role = 'assigned')")
def t09(spark: SparkSession, d: str) -> DataFrame:
    return L.other_reads(_statements(spark, d), "p7").select("path", "statements")


@query(
    "t10_link_section",
    """WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'view' THEN 1 ELSE 0 END AS rank, 'u' || (user_id % 12) AS path, event_id AS line, event_type AS why FROM events WHERE value > 50),
    m AS (SELECT rank, path, why, min(line) AS line, arg_min(why, line) AS text, list_sort(list(line)) AS lines FROM e GROUP BY 1, 2, 3), p AS (SELECT *, row_number() OVER (PARTITION BY rank < 2 ORDER BY rank, path, line, text) AS place FROM m),
    n AS (SELECT least(10, count(*) FILTER (rank < 2)) AS n FROM m) SELECT rank, path, line, lines, text, why, place <= CASE WHEN rank < 2 THEN 10 ELSE greatest(3, least(5, 10 - n)) END AS shown FROM p, n""",
)
def t10(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    e = table(spark, d, "events").filter("value > 50").select(rank.alias("rank"), F.concat(F.lit("u"), F.col("user_id") % 12).alias("path"), F.col("event_id").alias("line"), F.col("event_type").alias("why"), F.col("event_type").alias("text"))
    return L.link_section(e, 10)


UNKNOWN, NAMES = [("k_levl",), ("v_stokc",), ("k_yaer",), ("zz",)], [("k_level",), ("k_levels",), ("k_year",), ("v_stock",), ("v_stocks",), ("k_lever",)]


@query(
    "t22_close_names",
    f"""WITH {values('u', 'name', UNKNOWN)}, {values('k', 'known', NAMES)}, s AS (SELECT name, known, 1 - levenshtein(name, known) / greatest(length(name), length(known)) AS likeness FROM u JOIN k ON left(name, 2) = left(known, 2)),
    r AS (SELECT name, known, row_number() OVER (PARTITION BY name ORDER BY likeness DESC, known) AS place FROM s WHERE likeness >= 0.7)
    SELECT u.name, coalesce(list(known ORDER BY place) FILTER (known IS NOT NULL), []) AS close FROM u LEFT JOIN (SELECT * FROM r WHERE place <= 2) r USING (name) GROUP BY 1""",
)
def t22(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.close_names(fixture(spark, "name string", UNKNOWN), fixture(spark, "name string", NAMES))


_COUPLING = """own AS (SELECT p_partkey AS symbol, p_partkey % 12 AS owner FROM part), use AS (SELECT l_partkey AS symbol, l_suppkey % 12 AS user, l_returnflag AS phase, CASE WHEN l_linestatus = 'O' THEN 'assigned' ELSE 'read' END AS role FROM lineitem WHERE l_quantity > 48),
  facts AS (SELECT * FROM use JOIN own USING (symbol) WHERE owner <> user)"""


def _coupling(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % 12).alias("owner"))
    role = F.when(F.col("l_linestatus") == "O", "assigned").otherwise("read")
    uses = table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("symbol"), (F.col("l_suppkey") % 12).alias("user"), F.col("l_returnflag").alias("phase"), role.alias("role"))
    return sweeps.coupling(owners, uses)


@query("t27_coupling", f"WITH {_COUPLING} SELECT owner, user, string_agg(DISTINCT phase, '+' ORDER BY phase) AS phases, count(DISTINCT symbol) AS symbols, bool_or(role = 'assigned') AS writes FROM facts GROUP BY 1, 2")
def t27(spark: SparkSession, d: str) -> DataFrame:
    return _coupling(spark, d)


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8)]
_REACH = f"""WITH RECURSIVE {values('e', 'src, dst', EDGES)}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"""


@query("t28_reachable", f"{_REACH} SELECT DISTINCT src, dst FROM r")
def t28(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.reachable(fixture(spark, "src int, dst int", EDGES))


@query("t29_strong_components", f"{_REACH} SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src")
def t29(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.strong_components(fixture(spark, "src int, dst int", EDGES))


@query("s03_tracked_files", "SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'es' AND n_chars > 4000)")
def s03(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    listing = docs.filter("lang = 'es' and n_chars > 4000").select(F.col("source").alias("path"))
    return R.tracked_only(docs.select("doc_id", F.col("source").alias("path")), listing).select("doc_id")


CSV = [("a.csv", 1, "title;copyConfigFrom;description;cm_a;cm_b"), ("a.csv", 2, "A;;base;1;x"), ("a.csv", 3, "B;A;;2;"), ("a.csv", 4, ""), ("a.csv", 5, "#D;A;;;"), ("a.csv", 6, 'E;A;"a;b"')]


@query(
    "s05_scenario_rows",
    f"""WITH {values('t', 'path, n, line', CSV)}, c AS (SELECT path, n, regexp_extract_all(line || ';', '("[^"]*"|[^;]*);', 1) AS cells FROM t WHERE line <> ''),
    h AS (SELECT path, arg_min(cells, n) AS names FROM c GROUP BY 1), r AS (SELECT n, cells, names, unnest(generate_series(1, len(cells))) AS i FROM c JOIN h USING (path) WHERE n > 1 AND cells[1] NOT LIKE '#%')
    SELECT cells[1] AS name, nullif(cells[list_position(names, 'copyConfigFrom')], '') AS parent, names[i] AS key, trim(cells[i], '"') AS value FROM r WHERE cells[i] <> '' AND names[i] NOT IN ('title', 'copyConfigFrom')""",
)
def s05(spark: SparkSession, d: str) -> DataFrame:
    rows = R.scenario_rows(fixture(spark, "path string, n int, line string", CSV))
    return rows.select("name", "parent", F.explode("cells").alias("key", "value"))


CFG = [(1, "cfg$Title <- 'x' # name"), (2, "cfg$gms$cm_a <- 1"), (3, "cfg$title <- \"y\""), (4, "other <- 1"), (5, "cfg$model<-main.gms")]


@query(
    "s06_key_values",
    f"""WITH {values('t', 'n, line', CFG)}, p AS (SELECT n, lower(regexp_extract(line, '^cfg\\$(\\w+)\\s*<-', 1)) AS key, trim(regexp_extract(line, '<-\\s*([^#]*)', 1), ' ' || chr(34) || chr(39)) AS value FROM t)
    SELECT key, arg_max(value, n) AS value FROM p WHERE key <> '' GROUP BY 1""",
)
def s06(spark: SparkSession, d: str) -> DataFrame:
    return R.key_values(fixture(spark, "n int, line string", CFG))


_KEY = "sha1('m|' || left(text, 1000))"


@query(
    "s16_vector_cache",
    f"""WITH cache AS (SELECT {_KEY} AS key, arg_min(embedding, doc_id) AS vector FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang <> 'en' GROUP BY 1)
    SELECT doc_id, vector IS NOT NULL AS reused, list_sum(vector::DOUBLE[]) AS total FROM (SELECT doc_id, {_KEY} AS key FROM documents) LEFT JOIN cache USING (key)""",
)
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of an earlier snapshot (that of all languages but one) are read by content key, whole; the others are to be embedded."""
    key = content_key(F.lit("m"), visible(F.col("text"))).alias("key")
    docs = table(spark, d, "documents")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    old = docs.filter("lang <> 'en'").select("doc_id", key).join(vectors, "doc_id").groupBy("key").agg(F.min_by("embedding", "doc_id").alias("vector"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return docs.select("doc_id", key).join(old, "key", "left").select("doc_id", F.col("vector").isNotNull().alias("reused"), total.alias("total"))


@query("s15_meta", "SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents)::VARCHAR), ('model', 'none')) t(key, value)")
def s15(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("documents").alias("key"), "value")
    return n.unionAll(fixture(spark, "key string, value string", [("model", "none")]))


@query("c14_parse_checks", "SELECT 'no definition' AS finding, count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT 'unbalanced', count(*) FROM pages WHERE length(replace(html, '<', '')) <> length(replace(html, '>', ''))")
def c14(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().join(table(spark, d, "customer"), "c_custkey", "left_anti")
    odd = table(spark, d, "pages").filter(F.length(F.replace("html", F.lit("<"), F.lit(""))) != F.length(F.replace("html", F.lit(">"), F.lit(""))))
    row = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
    return row(gone, "no definition").unionAll(row(odd, "unbalanced"))


@query("c11_row_chunks", "SELECT c_custkey, left('Scenario ' || c_name || chr(10) || 'Settings: nation = ' || c_nationkey || '; segment = ' || c_mktsegment, 2500) AS text FROM customer")
def c11(spark: SparkSession, d: str) -> DataFrame:
    held = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    pairs = F.array_join(F.transform(F.map_entries(held), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "; ")
    return table(spark, d, "customer").select("c_custkey", F.left(F.concat(F.lit("Scenario "), "c_name", F.lit("\nSettings: "), pairs), F.lit(2500)).alias("text"))


@query("c12_interface_lists", "SELECT s_nationkey AS module, 'Outputs of ' || s_nationkey || chr(10) || string_agg(s_name, chr(10) ORDER BY s_name) AS text FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def c12(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("module")).agg(F.array_join(F.sort_array(F.collect_list("s_name")), "\n").alias("names"))
    return by.select("module", F.concat(F.lit("Outputs of "), "module", F.lit("\n"), "names").alias("text"))


@query("c13_first_tagged_line", "SELECT doc_id, (SELECT min(i) FROM (SELECT unnest(generate_series(1, len(string_split(text, chr(10))))) AS i) WHERE contains(string_split(text, chr(10))[i], ' the ')) AS line FROM documents")
def c13(spark: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.transform(F.split("text", "\n"), lambda x: x.contains(" the ")), F.lit(True))
    return table(spark, d, "documents").select("doc_id", F.nullif(place, F.lit(0)).alias("line"))
