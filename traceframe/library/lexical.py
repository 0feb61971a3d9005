"""Lines of text and their state: L01-L16, C01-C05, C09, W03-W06, W12, F26."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import lines as L
from traceframe.functions import text as T
from traceframe.library.common import LINES_SQL, documents_lines, fixture, values
from traceframe.operators import packing as P

CODE = [
    (1, 'p_x = 1; !! "a;b" is not code'), (2, 'display "a;b";'), (3, "parameter"), (4, "positive variables vm_x(t)"), (5, "Scalars"), (6, "sets_x(t) = yes;"),
    (7, "* parameter in a comment"), (8, "set_x(t) = 1;"), (9, "p_s = 'it is !! here'; !! tail"), (10, '$ifthen "%a_b%" == "x"  + p_a(t)'), (11, "$ifthen %o% == 'quick'"),
]
PATHS = [("modules/12_storage/tank/equations.gms",), ("core/bounds.gms",), ("main.gms",), ("modules/14_Fuel_mix/load/sets.gms",), ("scripts/a.R",)]
EQUATIONS = [(1, "* head\nq_x(t)$(cm_x eq 2)..\n v_x =e= 1;"), (2, "q_y(t,r).. v_y =g= 0;")]

#: A document line that starts so stands for a comment; these open and close a text block; a full stop ends a statement.
COMMENT, ON, OFF, ENDS = "line LIKE 'A%'", "line LIKE 'Th%'", "line LIKE 'O%'", "line LIKE '%.'"


@query("l01_comment_lines", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line LIKE 'A%') AS n_comments FROM lines GROUP BY doc_id")
def l01(spark: SparkSession, d: str) -> DataFrame:
    return documents_lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(L.is_comment(F.col("line"), "A")).alias("n_comments"))


@query("l02_code_part", f"WITH {values('t', 'id, line', CODE)} SELECT id, split_part(regexp_replace(line, '\"[^\"]*\"|''[^'']*''', '', 'g'), '!!', 1) AS code FROM t")
def l02(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, line string", CODE).select("id", L.code_part(F.col("line")).alias("code"))


_BLOCK_SQL = """blocks AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false)
    OR (line LIKE 'O%' AND coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS in_block
  FROM (SELECT *, CASE WHEN line LIKE 'Th%' THEN true WHEN line LIKE 'O%' THEN false END AS m FROM lines))"""


@query("l03_text_block_mask", f"WITH {LINES_SQL}, {_BLOCK_SQL} SELECT doc_id, n, in_block FROM blocks")
def l03(spark: SparkSession, d: str) -> DataFrame:
    return L.in_block(documents_lines(spark, d), "doc_id", F.expr(ON), F.expr(OFF)).select("doc_id", "n", "in_block")


@query("l04_strip_comments", f"WITH {LINES_SQL}, {_BLOCK_SQL} SELECT doc_id, string_agg(split_part(line, ' of ', 1), chr(10) ORDER BY n) AS text FROM blocks WHERE NOT in_block AND line NOT LIKE 'A%' GROUP BY doc_id")
def l04(spark: SparkSession, d: str) -> DataFrame:
    return L.strip_comments(documents_lines(spark, d), "doc_id", F.expr(COMMENT), F.expr(ON), F.expr(OFF), " of ")


@query(
    "l05_statement_end",
    f"WITH {LINES_SQL} SELECT doc_id, n, coalesce(min(CASE WHEN line LIKE '%.' THEN n END) OVER w, max(n) OVER w) AS \"end\" FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
)
def l05(spark: SparkSession, d: str) -> DataFrame:
    return L.statement_end(documents_lines(spark, d), "doc_id", F.expr(ENDS)).select("doc_id", "n", "end")


@query(
    "l06_statement_id",
    f"WITH {LINES_SQL} SELECT doc_id, n, coalesce(sum(CASE WHEN line LIKE '%.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS statement FROM lines",
)
def l06(spark: SparkSession, d: str) -> DataFrame:
    return L.statement_id(documents_lines(spark, d), "doc_id", F.expr(ENDS)).select("doc_id", "n", "statement")


_DECL = r"(?i)^\s*((?:positive\s+)?(?:parameters?|scalars?|sets?|variables?))(?:[\s\"'(].*)?$"


@query("l07_declaration_start", f"WITH {values('t', 'id, line', CODE)} SELECT id, lower(regexp_extract(line, '{_DECL.replace(chr(39), chr(39) * 2)}', 1)) AS kind FROM t")
def l07(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, line string", CODE).select("id", F.lower(F.regexp_extract("line", _DECL, 1)).alias("kind"))


_TEST = r"^\$ifthen(?:\.\w+)?\s+(\S+\s*==\s*\S+)\s*(.*)$"


@query("l08_directive_test", f"WITH {values('t', 'id, line', CODE)} SELECT id, regexp_extract(line, '{_TEST}', 1) AS test, regexp_extract(line, '{_TEST}', 2) AS code FROM t")
def l08(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, "id int, line string", CODE).select("id", F.regexp_extract("line", _TEST, 1).alias("test"), F.regexp_extract("line", _TEST, 2).alias("code"))


@query(
    "l09_depth_and_opener",
    f"""WITH {LINES_SQL} SELECT doc_id, n, sum(CASE WHEN line LIKE 'Th%' THEN 1 ELSE 0 END - CASE WHEN line LIKE 'O%' THEN 1 ELSE 0 END) OVER w AS depth,
    last_value(CASE WHEN line LIKE 'Th%' THEN n END IGNORE NULLS) OVER w AS opener FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def l09(spark: SparkSession, d: str) -> DataFrame:
    return L.depth(documents_lines(spark, d), "doc_id", F.expr(ON), F.expr(OFF)).select("doc_id", "n", "depth", "opener")


@query(
    "l15_equation_domain",
    f"""WITH {values('t', 'id, text', EQUATIONS)}, d AS (SELECT id, trim(split_part(regexp_replace(text, '(^|\\n)\\*[^\\n]*\\n', '\\1', 'g'), '..', 1)) AS domain FROM t)
    SELECT id, domain, CASE WHEN instr(domain, '$') > 0 THEN substr(domain, instr(domain, '$') + 1) END AS condition FROM d""",
)
def l15(spark: SparkSession, d: str) -> DataFrame:
    domain = fixture(spark, "id int, text string", EQUATIONS).select("id", T.equation_domain(F.col("text")).alias("domain"))
    return domain.withColumn("condition", T.equation_condition(F.col("domain")))


@query(
    "l16_path_metadata",
    f"""WITH {values('t', 'path', PATHS)} SELECT path, nullif(regexp_extract(path, '^modules/(\\d+_[^/]+)', 1) || regexp_extract(path, '^(core)/', 1), '') AS module,
    nullif(regexp_extract(path, '^modules/\\d+_[^/]+/([^/.]+)/', 1), '') AS realization,
    nullif(regexp_extract(path, '^(?:modules/\\d+_[^/]+/[^/.]+|core)/([^/.]+)\\.[^/]*$', 1), '') AS phase FROM t""",
)
def l16(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return fixture(spark, "path string", PATHS).select("path", *[T.path_part(path, p).alias(p) for p in ("module", "realization", "phase")])


@query(
    "l19_prose_lines",
    f"WITH {LINES_SQL}, {_BLOCK_SQL} SELECT doc_id, n, line AS prose FROM blocks WHERE in_block OR line LIKE 'A%'",
)
def l19(spark: SparkSession, d: str) -> DataFrame:
    return L.in_block(documents_lines(spark, d), "doc_id", F.expr(ON), F.expr(OFF)).filter(F.col("in_block") | F.expr(COMMENT)).select("doc_id", "n", F.col("line").alias("prose"))


@query(
    "c01_segments",
    f"""WITH {LINES_SQL}, cuts AS (SELECT doc_id, n FROM lines WHERE n = 1 OR line LIKE 'A%')
    SELECT c.doc_id, n AS start, coalesce(lead(n) OVER (PARTITION BY c.doc_id ORDER BY n), e.last + 1) AS "end" FROM cuts c JOIN (SELECT doc_id, max(n) AS last FROM lines GROUP BY 1) e USING (doc_id)""",
)
def c01(spark: SparkSession, d: str) -> DataFrame:
    return P.segments(documents_lines(spark, d), "doc_id", F.expr(COMMENT))


_SIZES = f"{LINES_SQL}, sized AS (SELECT doc_id, n, length(line) + 1 AS size FROM lines)"
_PACK = """RECURSIVE placed(doc_id, n, used, chunk) AS (
    SELECT doc_id, n, size, 1 FROM sized WHERE n = 1
    UNION ALL SELECT s.doc_id, s.n, CASE WHEN p.used + s.size > 1200 THEN s.size ELSE p.used + s.size END, CASE WHEN p.used + s.size > 1200 THEN p.chunk + 1 ELSE p.chunk END
    FROM placed p JOIN sized s ON s.doc_id = p.doc_id AND s.n = p.n + 1)"""


@query(
    "c02_split_to_cap",
    f"WITH RECURSIVE {_SIZES}, {_PACK.removeprefix('RECURSIVE ')} SELECT doc_id, chunk::BIGINT AS chunk, min(n) AS line_start, max(n) AS line_end FROM placed GROUP BY 1, 2",
)
def c02(spark: SparkSession, d: str) -> DataFrame:
    return P.greedy(documents_lines(spark, d).withColumn("size", F.length("line") + 1), "doc_id", "size", 1200)


@query(
    "c03_pack_segments",
    f"""WITH RECURSIVE {LINES_SQL}, seg AS (SELECT doc_id, k, sum(length(line) + 1) AS size, min(n) AS s, max(n) AS e FROM
      (SELECT *, sum(CASE WHEN line LIKE 'A%' OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM lines) GROUP BY 1, 2),
    merged(doc_id, k, used, chunk) AS (
      SELECT doc_id, k, size, 1 FROM seg WHERE k = 1
      UNION ALL SELECT g.doc_id, g.k, CASE WHEN m.used < 300 AND m.used + g.size <= 900 THEN m.used + g.size ELSE g.size END, CASE WHEN m.used < 300 AND m.used + g.size <= 900 THEN m.chunk ELSE m.chunk + 1 END
      FROM merged m JOIN seg g ON g.doc_id = m.doc_id AND g.k = m.k + 1)
    SELECT m.doc_id, m.chunk::BIGINT AS chunk, min(g.s) AS line_start, max(g.e) AS line_end, sum(g.size)::BIGINT AS size FROM merged m JOIN seg g ON g.doc_id = m.doc_id AND g.k = m.k GROUP BY 1, 2""",
)
def c03(spark: SparkSession, d: str) -> DataFrame:
    return P.pack_segments(P.sized_segments(documents_lines(spark, d), "doc_id", F.expr(COMMENT)), "doc_id", 300, 900)


@query(
    "c04_trim_blank_edges",
    f"""WITH {LINES_SQL}, chunked AS (SELECT *, (n - 1) // 5 AS chunk FROM lines) SELECT doc_id, chunk, min(n) FILTER (trim(line) <> '') AS line_start, max(n) FILTER (trim(line) <> '') AS line_end
    FROM chunked GROUP BY 1, 2 HAVING min(n) FILTER (trim(line) <> '') IS NOT NULL""",
)
def c04(spark: SparkSession, d: str) -> DataFrame:
    rows = documents_lines(spark, d).withColumn("chunk", F.floor((F.col("n") - 1) / 5).cast("bigint"))
    return P.trim_edges(rows, "doc_id", "chunk")


CONDITIONS = [(1, 1, ["a", "b", "c"]), (1, 2, ["b", "a"]), (1, 3, ["a", "c", "b"]), (2, 1, ["x"]), (2, 2, []), (3, 1, ["q", "q", "r"])]


@query(
    "c05_common_conditions",
    f"""WITH {values('t', 'chunk, n, conditions', CONDITIONS)}, each AS (SELECT DISTINCT chunk, n, unnest(conditions) AS c FROM t),
    whole AS (SELECT chunk, count(*) AS lines FROM t GROUP BY 1),
    always AS (SELECT e.chunk, list(c) AS cs FROM (SELECT chunk, c, count(*) AS n FROM each GROUP BY 1, 2) e JOIN whole w ON e.chunk = w.chunk AND e.n = w.lines GROUP BY 1)
    SELECT t.chunk, list_filter(conditions, lambda c: list_contains(coalesce(cs, []), c)) AS common FROM t LEFT JOIN always a ON a.chunk = t.chunk WHERE n = 1""",
)
def c05(spark: SparkSession, d: str) -> DataFrame:
    rows = fixture(spark, "chunk int, n int, conditions array<string>", CONDITIONS)
    return P.common_conditions(rows, "chunk", "n", "conditions")


@query(
    "c09_sections",
    f"""WITH {LINES_SQL}, h AS (SELECT *, CASE WHEN line LIKE 'A%' THEN 1 WHEN line LIKE 'Th%' THEN 2 WHEN line LIKE 'O%' THEN 3 END AS level, left(line, 5) AS title FROM lines),
    c AS (SELECT *, last_value(CASE WHEN level <= 1 THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN level <= 2 THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER w AS b,
      last_value(CASE WHEN level <= 3 THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT doc_id, n, concat_ws(' > ', CASE WHEN a.l = 1 THEN a.t END, CASE WHEN b.l = 2 THEN b.t END, CASE WHEN c.l = 3 THEN c.t END) AS crumb FROM c""",
)
def c09(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.expr(COMMENT), 1).when(F.expr(ON), 2).when(F.expr(OFF), 3)
    return L.breadcrumbs(documents_lines(spark, d), "doc_id", level, F.left("line", F.lit(5)), 3).select("doc_id", "n", "crumb")


@query(
    "w05_comment_islands",
    f"""WITH {LINES_SQL} SELECT doc_id, n, CASE WHEN c THEN sum(CASE WHEN c AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) END::BIGINT AS island
    FROM (SELECT *, line LIKE 'A%' AS c, lag(line LIKE 'A%') OVER (PARTITION BY doc_id ORDER BY n) AS p FROM lines)""",
)
def w05(spark: SparkSession, d: str) -> DataFrame:
    return L.block_above(documents_lines(spark, d), "doc_id", F.expr(COMMENT)).select("doc_id", "n", "island")


@query(
    "w06_nearest_marked_line",
    f"""WITH {LINES_SQL} SELECT doc_id, n, CASE WHEN n - m <= 15 THEN m END AS marked FROM
    (SELECT *, last_value(CASE WHEN line LIKE 'A%' THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lines)""",
)
def w06(spark: SparkSession, d: str) -> DataFrame:
    return L.nearest_before(documents_lines(spark, d), "doc_id", F.expr(COMMENT), 15).select("doc_id", "n", "marked")


@query(
    "f26_section_sizes",
    f"""WITH {LINES_SQL} SELECT doc_id, section::BIGINT AS section, sum(length(line) + 1)::BIGINT AS chars FROM
    (SELECT *, sum(CASE WHEN line LIKE 'A%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM lines) GROUP BY 1, 2""",
)
def f26(spark: SparkSession, d: str) -> DataFrame:
    return P.section_sizes(documents_lines(spark, d), "doc_id", F.expr(COMMENT))
