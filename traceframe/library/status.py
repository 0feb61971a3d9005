"""Status of code under settings, statements, scenario names, coverage: G10-G12, M06, J25, T04, E09, E10, O10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import kleene as K
from traceframe.functions import lines as L
from traceframe.library.common import LINES_SQL, documents_lines, fixture, table, values
from traceframe.operators import lineage, quality, search, source
from traceframe.operators import status as S

SETTINGS = {"storage": "tank", "trade": "off", "k_on": "yes", "k_year": "1990"}
#: Conditions, and what they are in SQL under the settings.
TRUTH = {"k_on eq 'yes'": "'yes' = 'yes'", "k_year gt 2005": "1990 > 2005", "k_year lt 2005 and f(t)": "1990 < 2005 AND CAST(NULL AS BOOLEAN)"}
CHUNKS = [
    (1, "gams_block", "a.gms", 1, 9, "12_storage", "tank", ["k_on eq 'yes'"]), (2, "equation", "a.gms", 10, 20, "12_storage", "none", []), (3, "declaration", "b.gms", 1, 5, "03_trade", "free", ["k_year gt 2005", "k_year lt 2005 and f(t)"]),
    (4, "gams_block", "b.gms", 6, 30, None, None, []), (5, "switch", "b.gms", 1, 30, None, None, []),
]
TESTS = [("a.gms", 2, "k_on", "==", "yes"), ("a.gms", 3, "k_year", "gt", "2000"), ("a.gms", 4, "k_on", "==", "yes"), ("a.gms", 12, "k_gone", "eq", "1"), ("b.gms", 7, "k_year", "eq", "1990"), *[("b.gms", 8 + i, "k_year", "ge", str(1985 + i)) for i in range(5)]]


def _map() -> F.Column:
    return F.create_map(*[F.lit(x) for kv in SETTINGS.items() for x in kv])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TOLD = "CASE WHEN v THEN 'holds with the defaults' WHEN NOT v THEN 'is off with the defaults' ELSE 'is left open by the settings' END"


@query(
    "g10_chunk_status",
    f"""WITH {values('c', 'id, kind, path, s, e, module, realization, conditions', CHUNKS)}, {values('t', 'path, n, name, cmp, value', TESTS)}, {values('m', 'name, held', list(SETTINGS.items()))},
    truth AS (SELECT * FROM (VALUES {', '.join(f"({_quoted(t)}, {sql})" for t, sql in TRUTH.items())}) x(text, v)),
    real AS (SELECT id, 'realization ' || realization || CASE WHEN held = realization THEN ': selected by the defaults' WHEN held IN ('off', 'none') THEN ': not selected by the defaults (the module is switched off: ' || name || ' = ' || held || ')' ELSE ': not selected by the defaults (' || name || ' = ' || held || ')' END AS text
      FROM c JOIN m ON m.name = substr(module, 4)),
    cond AS (SELECT id, i, 'compiled only if ' || text || ': ' || {_TOLD} AS text FROM (SELECT id, unnest(conditions) AS text, generate_subscripts(conditions, 1) AS i FROM c) JOIN truth USING (text)),
    tested AS (SELECT DISTINCT ON (id, shown) id, n, shown FROM (SELECT id, n, name || ' ' || cmp || ' ' || value || ' → ' || CASE cmp WHEN '==' THEN held = value WHEN 'eq' THEN held = value WHEN 'gt' THEN TRY_CAST(held AS INT) > TRY_CAST(value AS INT) ELSE TRY_CAST(held AS INT) >= TRY_CAST(value AS INT) END AS shown
      FROM c JOIN t ON t.path = c.path AND n BETWEEN s AND e JOIN m USING (name) WHERE kind IN ('equation', 'gams_block', 'declaration')) ORDER BY id, shown, n),
    listed AS (SELECT id, list(shown ORDER BY n, shown) AS l FROM tested GROUP BY 1)
    SELECT id, 0 AS place, text FROM real UNION ALL SELECT id, i::INT, text FROM cond
    UNION ALL SELECT id, 1000, 'tests of switches, with the defaults: ' || array_to_string(l[1:4], '; ') || CASE WHEN len(l) > 4 THEN ' (+' || (len(l) - 4) || ' more)' ELSE '' END FROM listed""",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    chunks = fixture(spark, "id int, kind string, path string, line_start int, line_end int, module string, realization string, conditions array<string>", CHUNKS)
    parsed = K.parsed(chunks.select(F.explode("conditions").alias("text")))
    return S.chunk_status(chunks, parsed, fixture(spark, "path string, n int, name string, cmp string, value string", TESTS), _map())


EQUATIONS = [(1, "e_a(t)$(k_year gt 2005)..\n x =e= 1;"), (2, "* about\ne_b(t)$(k_on eq 'yes').. x =e= 1;"), (3, "e_c(t).. x =e= 1;"), (4, "e_d(t)$(ord(t) gt 1).. x =e= 1;"), (5, "e_e(t)$(k_year lt 2005 and f(t)).. x =e= 1;")]


@query(
    "g11_equation_status",
    f"""WITH {values('q', 'id, text', EQUATIONS)}, truth AS (SELECT * FROM (VALUES {', '.join(f"({_quoted(t)}, {sql})" for t, sql in TRUTH.items())}) x(condition, v)),
    c AS (SELECT id, regexp_extract(text, '\\$\\((.*)\\)\\s*\\.\\.', 1) AS condition FROM q) SELECT id, condition, v AS value FROM c JOIN truth USING (condition) WHERE v IS NOT TRUE""",
)
def g11(spark: SparkSession, d: str) -> DataFrame:
    return S.equation_status(fixture(spark, "id int, text string", EQUATIONS), _map())


@query(
    "g12_reason_with_reach",
    """SELECT id, CASE WHEN off THEN text || '; holds in ' || (SELECT count(*) FILTER (CASE text WHEN 'segment eq ''MACHINERY''' THEN c_mktsegment = 'MACHINERY' ELSE c_nationkey <= 5 END) FROM customer) || ' of ' || (SELECT count(*) FROM customer) || ' configurations' ELSE text END AS text, off
    FROM (VALUES (1, 'segment eq ''MACHINERY''', true), (2, 'nation le 5', true), (3, 'nation le 5', false)) r(id, text, off)""",
)
def g12(spark: SparkSession, d: str) -> DataFrame:
    texts = ["segment eq 'MACHINERY'", "nation le 5"]
    held = F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    reach = K.reach(table(spark, d, "customer").select(held.alias("s")), "s", {t: t for t in texts})
    return S.with_reach(fixture(spark, "id int, text string, off boolean", [(1, texts[0], True), (2, texts[1], True), (3, texts[1], False)]), reach)


SCENARIOS = [("Low-A", "config/other.csv", 2), ("Low-A", "config/main.csv", 9), ("Low-A-late", "config/main.csv", 3), ("High", "config/other.csv", 4), ("high", "config/other.csv", 5), ("B", "config/main.csv", 7), ("C2", "config/main.csv", 8)]
ASKED = [(1, "how do low-a and LOW-A-LATE differ?"), (2, "B, C2, high and Low-A"), (3, "xHigh B-C2 nothing"), (4, "B")]


@query(
    "m06_scenarios_in_query",
    f"""WITH {values('s', 'name, path, line', SCENARIOS)}, {values('q', 'q, text', ASKED)}, f AS (SELECT lower(name) AS word, arg_min(struct_pack(name := name, path := path, line := line), struct_pack(o := path <> 'config/main.csv', p := path, l := line)) AS s FROM s GROUP BY 1),
    m AS (SELECT q, s.name AS name, s.path AS path, s.line AS line FROM q JOIN f ON list_contains(regexp_extract_all(lower(text), '[\\w-]+'), word)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY length(name) DESC, name) AS place FROM m) WHERE place <= 3""",
)
def m06(spark: SparkSession, d: str) -> DataFrame:
    return search.named_scenarios(fixture(spark, "q int, text string", ASKED), fixture(spark, "name string, path string, line int", SCENARIOS), ["q"], "config/main.csv")


@query(
    "j25_symbol_in_interface",
    """WITH chunks AS (SELECT s_nationkey AS id, 'Outputs of ' || s_nationkey || chr(10) || string_agg(s_name || ': from ' || s_suppkey, chr(10)) AS text FROM supplier GROUP BY 1), names AS (SELECT s_name AS name FROM supplier WHERE s_acctbal > 5000)
    SELECT name, id FROM chunks JOIN names ON instr(text, chr(10) || name || ':') > 0""",
)
def j25(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    line = F.concat("s_name", F.lit(": from "), "s_suppkey")
    by = s.groupBy(F.col("s_nationkey").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("lines"))
    chunks = by.select("id", F.lit("module_interface").alias("kind"), F.concat(F.lit("Outputs of "), "id", F.lit("\n"), "lines").alias("text"))
    return lineage.interface_definitions(chunks, s.filter("s_acctbal > 5000").select(F.col("s_name").alias("name")))


_STATE = "SELECT *, line LIKE '%.' AS ends, line LIKE 'Th%' AS barrier, trim(line) <> '' AND line NOT LIKE 'A%' AS code FROM lines"


@query(
    "t04_statement_at_line",
    f"""WITH {LINES_SQL}, st AS ({_STATE}), last AS (SELECT doc_id, max(n) AS e FROM lines GROUP BY 1), p AS (SELECT doc_id, n AS pt, e FROM lines JOIN last USING (doc_id) WHERE contains(line, ' con ')),
    near AS (SELECT p.*, st.n, ends, barrier, code FROM p JOIN st ON st.doc_id = p.doc_id AND st.n BETWEEN greatest(1, pt - 40) AND least(e, pt + 80)),
    b AS (SELECT doc_id, pt, greatest(coalesce(max(n + 1) FILTER (n < pt AND (ends OR barrier)), min(n)), min(n)) AS low, coalesce(min(n) FILTER (n >= pt AND ends), max(n)) AS "end" FROM near GROUP BY 1, 2)
    SELECT b.doc_id, b.pt AS n, coalesce(min(near.n) FILTER (code AND near.n BETWEEN low AND b.pt), b.pt) AS start, "end" FROM b JOIN near ON near.doc_id = b.doc_id AND near.pt = b.pt GROUP BY b.doc_id, b.pt, "end" """,
)
def t04(spark: SparkSession, d: str) -> DataFrame:
    rows = documents_lines(spark, d)
    state = rows.select("doc_id", "n", F.expr("line like '%.'").alias("ends"), F.expr("line like 'Th%'").alias("barrier"), F.expr("trim(line) <> '' and line not like 'A%'").alias("code"))
    spans = rows.groupBy("doc_id").agg(F.min("n").alias("s"), F.max("n").alias("e"))
    return lineage.statements_at(rows.filter(F.contains("line", F.lit(" con "))).select("doc_id", "n"), state, spans, "doc_id")


@query(
    "e09_covered_lines",
    f"""WITH {LINES_SQL}, st AS (SELECT *, coalesce(sum(CASE WHEN line LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS statement, line LIKE 'A%' AS entry FROM lines)
    SELECT doc_id, n, CASE WHEN entry THEN true WHEN line LIKE 'Th%' THEN false WHEN contains(line, ' la ') THEN bool_or(entry) OVER (PARTITION BY doc_id, statement) ELSE contains(line, 'e') OR contains(line, 'x') END AS covered FROM st""",
)
def e09(spark: SparkSession, d: str) -> DataFrame:
    rows = L.statement_id(documents_lines(spark, d), "doc_id", F.expr("line like '%.'"))
    has = lambda x: F.contains("line", F.lit(x))
    known = rows.select("doc_id", "n", "statement", F.expr("line like 'A%'").alias("entry"), F.expr("line like 'Th%'").alias("one_line_if"), has(" la ").alias("names"), has("e").alias("echoed"), has("x").alias("end_echoed"))
    return quality.covered_lines(known, "doc_id")


BLOCKS = [(1, "$ifthen.a %x% == 1"), (2, "a"), (3, "$ifthen %y% == 2"), (4, "b"), (5, "$else"), (6, "c"), (7, "$endif"), (8, "$elseif.a %x% == 2"), (9, "d"), (10, "$endif.a"), (11, "e"), (12, "$ifthen %z% == 3"), (13, "f")]
_ENDS = [(1, 10), (3, 7), (5, 7), (8, 10), (12, None)]


@query(
    "e10_block_end_and_context",
    f"""WITH {values('l', 'n, line', BLOCKS)}, {values('b', 'n, "end"', _ENDS)}, {values('r', 's, e', [(1, 8), (3, 5), (5, 7), (8, 10), (12, 99)])},
    c AS (SELECT l.n, max(s) AS s FROM l JOIN r ON s < l.n AND l.n < e GROUP BY 1) SELECT l.n, b."end", lower(o.line) AS context FROM l LEFT JOIN b USING (n) LEFT JOIN c USING (n) LEFT JOIN l o ON o.n = c.s""",
)
def e10(spark: SparkSession, d: str) -> DataFrame:
    text = "\n".join(line for _, line in BLOCKS)
    rows = source.source_lines(fixture(spark, "path string, text string", [("a.gms", text)]))
    return rows.select("path", "n").join(source.block_ends(rows), ["path", "n"], "left").join(source.block_context(rows), ["path", "n"], "left").select("n", "end", "context")


@query("o10_by_length", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS place FROM documents")
def o10(spark: SparkSession, d: str) -> DataFrame:
    """Texts to embed in the order of their lengths, within a part."""
    w = Window.partitionBy("source").orderBy(F.length("text"), "doc_id")
    return table(spark, d, "documents").select("doc_id", F.row_number().over(w).cast("bigint").alias("place"))
