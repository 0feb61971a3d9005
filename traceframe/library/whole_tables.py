"""Functions of the fixture queries over whole tables: F09, F12-F15, F19, L02, L07, L15, L16, J17, J26, E08."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import lines as L
from traceframe.functions import text as T
from traceframe.library.common import LINES_SQL, documents_lines, table
from traceframe.library.lexical import _DECL
from traceframe.library.projections import _BARE, _NUM


@query("f09_document_titles", "SELECT doc_id, trim(source || chr(10) || split_part(text, chr(10), 1) || ' ' || lang || ' ' || source) AS title FROM documents WHERE NOT starts_with(text, 'Uses:') AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def f09(spark: SparkSession, d: str) -> DataFrame:
    """Title of a document from its source, a line of used names (left out) and its first line."""
    docs = table(spark, d, "documents").filter("text not like 'Uses:%' and lang is not null and source is not null")
    header = F.concat("source", F.lit("\nUses: "), "lang", F.lit("\n"), F.substring_index("text", "\n", 1))
    return docs.select("doc_id", T.index_title(header, F.array("lang", "source")).alias("title"))


@query("f12_identifiers_of_pages", "SELECT page_id, regexp_extract_all(html, '[A-Za-z]\\w*_\\w+') AS names FROM pages WHERE html IS NOT NULL")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("html is not null").select("page_id", T.prefixed_identifiers(F.col("html")).alias("names"))


_OPS = ("eq", "ne", "lt", "le", "gt", "ge")
_LINE = f"""SELECT l_orderkey, l_linenumber, {list(_OPS)}[l_partkey % 6 + 1] AS op, CASE WHEN l_suppkey % 3 = 0 THEN ' "' || l_returnflag || '"' ELSE (l_quantity % 4)::INT::VARCHAR END AS l,
  CASE WHEN l_suppkey % 3 = 0 THEN lower(l_linestatus) WHEN l_suppkey % 3 = 1 THEN (l_linenumber % 4)::VARCHAR || '.0' ELSE l_returnflag END AS r FROM lineitem"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("l_suppkey") % 3
    left = F.when(third == 0, F.concat(F.lit(' "'), "l_returnflag", F.lit('"'))).otherwise((F.col("l_quantity") % 4).cast("int").cast("string"))
    right = F.when(third == 0, F.lower("l_linestatus")).when(third == 1, F.concat((F.col("l_linenumber") % 4).cast("string"), F.lit(".0"))).otherwise(F.col("l_returnflag"))
    op = F.get(F.array(*map(F.lit, _OPS)), (F.col("l_partkey") % 6).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", op.alias("op"), left.alias("l"), right.alias("r"))


@query(
    "f13_compared_lines",
    f"""WITH t AS ({_LINE}), b AS (SELECT *, {_BARE.format('l')} AS a, {_BARE.format('r')} AS c FROM t), n AS (SELECT *, CASE WHEN regexp_matches(a, {_NUM}) THEN TRY_CAST(a AS DOUBLE) END AS x, CASE WHEN regexp_matches(c, {_NUM}) THEN TRY_CAST(c AS DOUBLE) END AS y FROM b)
    SELECT l_orderkey, l_linenumber, op, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE op WHEN 'eq' THEN x = y WHEN 'ne' THEN x <> y WHEN 'lt' THEN x < y WHEN 'le' THEN x <= y WHEN 'gt' THEN x > y ELSE x >= y END
      WHEN op = 'eq' THEN lower(a) = lower(c) WHEN op = 'ne' THEN lower(a) <> lower(c) END AS holds FROM n""",
)
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with numbers, words with words in any case, and numbers with words."""
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "op", T.compare(F.col("l"), F.col("op"), F.col("r")).alias("holds"))


@query("f14_unquoted_lines", f"WITH t AS ({_LINE}) SELECT l_orderkey, l_linenumber, {_BARE.format('l')} AS bare FROM t")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("l_orderkey", "l_linenumber", T.unquoted(F.col("l")).alias("bare"))


_MODULE = "lpad((p_size % 100)::VARCHAR, 2, '0') || '_' || replace(p_brand, '#', '')"


@query(
    "f15_module_match_parts",
    f"""WITH t AS (SELECT p_partkey, lower({_MODULE}) AS m, lower(CASE p_partkey % 4 WHEN 0 THEN (p_size % 100)::VARCHAR WHEN 1 THEN ' ' || replace(p_brand, '#', '') WHEN 2 THEN upper({_MODULE}) ELSE '1' END) AS w FROM part), u AS (SELECT p_partkey, m, trim(w) AS w FROM t)
    SELECT p_partkey, m = w OR substr(m, instr(m, '_') + 1) = w OR split_part(m, '_', 1) = w OR (regexp_matches(w, '^\\d$') AND split_part(m, '_', 1) = lpad(w, 2, '0')) AS matches FROM u""",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    """A module of each part, asked for by number, name, whole name, or another number."""
    number, name = (F.col("p_size") % 100).cast("string"), F.replace("p_brand", F.lit("#"), F.lit(""))
    module = F.concat(F.lpad(number, 2, "0"), F.lit("_"), name)
    kind = F.col("p_partkey") % 4
    wanted = F.when(kind == 0, number).when(kind == 1, F.concat(F.lit(" "), name)).when(kind == 2, F.upper(module)).otherwise("1")
    return table(spark, d, "part").select("p_partkey", T.module_matches(module, wanted).alias("matches"))


@query(
    "f19_same_rates",
    """WITH t AS (SELECT l_orderkey, l_linenumber, round(l_discount * 100)::INT AS p, round(l_tax * 100)::INT AS q FROM lineitem), n AS (SELECT *, CASE q % 3 WHEN 0 THEN p WHEN 1 THEN p / 100 ELSE p + 1 END AS y, (p + q % 2)::DOUBLE AS x FROM t)
    SELECT l_orderkey, l_linenumber, abs(y - x) < 1e-9 OR abs(y / 100 - x) < 1e-9 OR abs(y - 1 - x) < 1e-9 OR abs(y * 100 - x) < 1e-9 AS same FROM n""",
)
def f19(spark: SparkSession, d: str) -> DataFrame:
    """Rates stated as numbers, as percentages and as changes against one."""
    p, q = F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    actual = F.when(q % 3 == 0, p.cast("double")).when(q % 3 == 1, p / 100).otherwise((p + 1).cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.same_value((p + q % 2).cast("double").cast("string"), actual.cast("string")).alias("same"))


@query("l02_code_of_pages", "SELECT page_id, md5(split_part(regexp_replace(html, '\"[^\"]*\"|''[^'']*''', '', 'g'), '!!', 1)) AS code FROM pages WHERE html IS NOT NULL")
def l02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("html is not null").select("page_id", F.md5(L.code_part(F.col("html"))).alias("code"))


@query("l07_declarations_of_documents", f"WITH {LINES_SQL} SELECT doc_id, n, lower(regexp_extract('Set ' || line, '{_DECL.replace(chr(39), chr(39) * 2)}', 1)) AS kind FROM lines")
def l07(spark: SparkSession, d: str) -> DataFrame:
    return documents_lines(spark, d).select("doc_id", "n", F.lower(F.regexp_extract(F.concat(F.lit("Set "), "line"), _DECL, 1)).alias("kind"))


_DOMAIN = "trim(split_part(regexp_replace(text, '(^|\\n)\\*[^\\n]*\\n', '\\1', 'g'), '..', 1))"


@query("l15_domains_of_documents", f"WITH t AS (SELECT doc_id, '* a comment' || chr(10) || 'q_' || source || '(t)$' || lang || ' .. ' || text AS text FROM documents), d AS (SELECT doc_id, {_DOMAIN} AS domain FROM t) SELECT doc_id, domain, CASE WHEN instr(domain, '$') > 0 THEN substr(domain, instr(domain, '$') + 1) END AS condition FROM d")
def l15(spark: SparkSession, d: str) -> DataFrame:
    """The head of an equation before each document's text."""
    text = F.concat(F.lit("* a comment\nq_"), "source", F.lit("(t)$"), "lang", F.lit(" .. "), "text")
    domain = table(spark, d, "documents").select("doc_id", T.equation_domain(text).alias("domain"))
    return domain.withColumn("condition", T.equation_condition(F.col("domain")))


_PATH = "CASE page_id % 3 WHEN 0 THEN 'modules/' || lpad((page_id % 90 + 10)::VARCHAR, 2, '0') || '_' || split_part(split_part(url, '/', 3), '.', 1) || '/real' || (page_id % 7)::VARCHAR || '/' || split_part(url, '/', 4) || '.gms' WHEN 1 THEN 'core/' || split_part(url, '/', 4) || '.gms' ELSE url END"


@query(
    "l16_paths_of_pages",
    f"""WITH t AS (SELECT page_id, {_PATH} AS path FROM pages) SELECT page_id, path, nullif(regexp_extract(path, '^modules/(\\d+_[^/]+)', 1) || regexp_extract(path, '^(core)/', 1), '') AS module,
    nullif(regexp_extract(path, '^modules/\\d+_[^/]+/([^/.]+)/', 1), '') AS realization, nullif(regexp_extract(path, '^(?:modules/\\d+_[^/]+/[^/.]+|core)/([^/.]+)\\.[^/]*$', 1), '') AS phase FROM t WHERE path IS NOT NULL""",
)
def l16(spark: SparkSession, d: str) -> DataFrame:
    """A path for each page, made of its address: a module's, a core file's, or the address."""
    part = lambda i: F.split_part("url", F.lit("/"), F.lit(i))
    text = lambda c: c.cast("string")
    module = F.concat(F.lit("modules/"), F.lpad(text(F.col("page_id") % 90 + 10), 2, "0"), F.lit("_"), F.split_part(part(3), F.lit("."), F.lit(1)), F.lit("/real"), text(F.col("page_id") % 7), F.lit("/"), part(4), F.lit(".gms"))
    path = F.when(F.col("page_id") % 3 == 0, module).when(F.col("page_id") % 3 == 1, F.concat(F.lit("core/"), part(4), F.lit(".gms"))).otherwise(F.col("url"))
    rows = table(spark, d, "pages").select("page_id", path.alias("path")).filter("path is not null")
    return rows.select("page_id", "path", *[T.path_part(F.col("path"), p).alias(p) for p in ("module", "realization", "phase")])


_WORDS = "unnest(regexp_extract_all({0}, '[A-Za-z]+_?'))"


@query("j17_words_unknown_to_talks", f"WITH k AS (SELECT DISTINCT lower({_WORDS.format('text')}) AS name FROM conversations), p AS (SELECT DISTINCT {_WORDS.format('text')} AS name FROM benchmark) SELECT name FROM p WHERE lower(name) NOT IN (SELECT name FROM k) AND regexp_replace(lower(name), '_$', '') NOT IN (SELECT name FROM k)")
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark that no conversation has, nor without a trailing underscore."""
    words = lambda t: table(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+_?"), F.lit(0))).alias("name"))
    known = words("conversations").select(F.lower("name").alias("known")).distinct()
    whole = words("benchmark").distinct().join(known, F.lower("name") == F.col("known"), "left_anti")
    return whole.join(known, F.regexp_replace(F.lower("name"), "_$", "") == F.col("known"), "left_anti")


@query(
    "j26_names_in_documents",
    """WITH s AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z0-9_-]+') AS name FROM benchmark), t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]+')) AS name FROM documents)
    SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS place FROM (SELECT DISTINCT doc_id, name FROM t JOIN s USING (name)) QUALIFY place <= 3""",
)
def j26(spark: SparkSession, d: str) -> DataFrame:
    """The first words of benchmark items that a document has, the three longest."""
    names = table(spark, d, "benchmark").select(F.regexp_extract("text", "[A-Za-z0-9_-]+", 0).alias("name")).distinct()
    words = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_-]+"), F.lit(0)))).alias("name"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.length("name")), "name")
    return words.join(names, "name").select("doc_id", "name", F.row_number().over(w).cast("bigint").alias("place")).filter("place <= 3")


@query("e08_compatible_lines", "SELECT l_orderkey, l_linenumber, (l_returnflag, l_linestatus) IN (SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.07) AS agrees FROM lineitem")
def e08(spark: SparkSession, d: str) -> DataFrame:
    """Flag and status agree if a large, highly taxed line has them together."""
    li = table(spark, d, "lineitem")
    fits = li.filter("l_quantity > 49 and l_tax > 0.07").select("l_returnflag", "l_linestatus").distinct().withColumn("fits", F.lit(True))
    return li.join(fits, ["l_returnflag", "l_linestatus"], "left").select("l_orderkey", "l_linenumber", F.coalesce("fits", F.lit(False)).alias("agrees"))
