"""Prose checks, steering and views: T16, T20, T23-T26."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.functions import kleene as K
from traceframe.library.common import fixture, table, values
from traceframe.operators import sweeps

PROSE = [
    ("README.md", 1, "The switch cm_rate has the default 5% and more."), ("README.md", 2, "cm_rate: default is 5%; cm_years: default is 2030."), ("doc.md", 3, "see modules/03_trade/x/sets.gms and 03_trade/x/sets.gms"),
    ("doc.md", 4, "look at core/gone.gms"), ("doc.md", 5, "set trade = free"), ("doc.md", 6, "set other = y, trade = x, land = b and trade = none"), ("doc.md", 7, "cm_rate, default: 0.05"),
]
SETTINGS, PATHS, KNOWN = [("cm_rate", "0.05"), ("cm_years", "2025")], [("modules/03_trade/x/sets.gms",), ("main.gms",)], [("03_trade", "x"), ("03_trade", "z"), ("04_land", "a")]


def _prose(spark: SparkSession) -> DataFrame:
    return fixture(spark, "path string, line int, text string", PROSE)


def _known(spark: SparkSession) -> DataFrame:
    return fixture(spark, "module string, realization string", KNOWN)


# One mention a line is enough here: the setting named last before the word, and the first number behind it.
@query(
    "t23_stated_defaults",
    f"""WITH {values('p', 'path, line, text', PROSE)}, {values('s', 'name, held', SETTINGS)},
    clauses AS (SELECT path, line, text, unnest(string_split(text, ';')) AS clause FROM p),
    cut AS (SELECT path, line, lower(substr(clause, 1, instr(lower(clause), 'default') - 1)) AS before, substr(clause, instr(lower(clause), 'default') + 7) AS after FROM clauses WHERE contains(lower(clause), 'default')),
    named AS (SELECT path, line, after, (SELECT arg_max(name, instr(before, name)) FROM s WHERE contains(before, name)) AS name FROM cut),
    raw AS (SELECT path, line, name, rtrim(regexp_extract(after, '[0-9][0-9.]*%?'), '.') AS raw FROM named),
    v AS (SELECT path, line, name, round(TRY_CAST(rtrim(raw, '%') AS DOUBLE) / CASE WHEN contains(raw, '%') THEN 100 ELSE 1 END, 9) AS stated, held::DOUBLE AS value FROM raw JOIN s USING (name))
    SELECT path, line, name, stated::VARCHAR AS stated, value::VARCHAR AS value FROM v WHERE least(abs(value - stated), abs(value / 100 - stated), abs(value - 1 - stated), abs(value * 100 - stated)) >= 1e-9""",
)
def t23(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.stated_defaults(_prose(spark), fixture(spark, "name string, value string", SETTINGS))


@query(
    "t24_file_pointers",
    f"""WITH {values('p', 'path, line, text', PROSE)}, {values('f', 'path', PATHS)}, s AS (SELECT path, line, unnest(regexp_extract_all(text, '\\b((?:[\\w-]+/)+[\\w-]+\\.(?:gms|R|md))\\b', 1)) AS pointer FROM p)
    SELECT * FROM s WHERE pointer NOT IN (SELECT path FROM f) AND 'modules/' || pointer NOT IN (SELECT path FROM f)""",
)
def t24(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.lost_pointers(_prose(spark), fixture(spark, "path string", PATHS))


@query(
    "t25_realization_names",
    f"""WITH {values('p', 'path, line, text', PROSE)}, {values('k', 'module, realization', KNOWN)}, m AS (SELECT lower(substr(module, instr(module, '_') + 1)) AS module, realization FROM k),
    s AS (SELECT path, line, lower(unnest(regexp_extract_all(text, '\\b([A-Za-z]\\w*)\\s*=\\s*["'']?([A-Za-z]\\w*)', 1))) AS module, unnest(regexp_extract_all(text, '\\b([A-Za-z]\\w*)\\s*=\\s*["'']?([A-Za-z]\\w*)', 2)) AS realization FROM p)
    SELECT * FROM s WHERE module IN (SELECT module FROM m) AND (module, realization) NOT IN (SELECT module, realization FROM m)""",
)
def t25(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.unknown_realizations(_prose(spark), _known(spark))


@query("t26_document_context", f"WITH {values('k', 'module, realization', KNOWN)}, {values('f', 'path', PATHS)}, {values('s', 'name, value', SETTINGS)} SELECT 'module' AS kind, module AS name FROM k UNION SELECT 'file', regexp_extract(path, '[^/]*$') FROM f UNION SELECT 'switch', lower(name) FROM s")
def t26(spark: SparkSession, d: str) -> DataFrame:
    files, switches = fixture(spark, "path string", PATHS), fixture(spark, "name string, value string", SETTINGS)
    parts = [_known(spark).select(F.lit("module").alias("kind"), F.col("module").alias("name")), files.select(F.lit("file"), F.regexp_extract("path", "[^/]*$", 0)), switches.select(F.lit("switch"), F.lower("name"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


MESSAGES = [(1, "03_trade", "x", "only works with z"), (2, "03_trade", "x", "x needs a"), (3, "04_land", "a", "z is fine here")]


@query("t20_message_issues", f"WITH {values('a', 'id, module, realization, message', MESSAGES)}, {values('k', 'module, realization', KNOWN)}, w AS (SELECT DISTINCT id, module, realization, unnest(regexp_extract_all(message, '[A-Za-z]\\w*')) AS named FROM a) SELECT id, named FROM w JOIN k ON k.module = w.module AND k.realization = named WHERE named <> w.realization")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.message_issues(fixture(spark, "id int, module string, realization string, message string", MESSAGES), _known(spark))


STEERED = [("03_trade", "x", "cm_a", "read"), ("03_trade", "x", "cm_a", "compile"), ("03_trade", "z", "cm_a", "guard"), ("03_trade", "z", "cm_b", "read"), ("04_land", "a", "cm_a", "read"), ("04_land", "off", "cm_a", "read")]


@query(
    "t16_steering",
    f"""WITH {values('u', 'module, realization, switch, kind', STEERED)}, {values('k', 'module, realization', KNOWN)}, b AS (SELECT module, realization, switch, min(list_position(['compile', 'guard', 'read'], kind)) AS r FROM u JOIN k USING (module, realization) GROUP BY 1, 2, 3),
    n AS (SELECT module, count(*) AS need FROM k GROUP BY 1), h AS (SELECT module, switch, count(*) AS have FROM b GROUP BY 1, 2)
    SELECT b.module, b.realization, b.switch, ['compile', 'guard', 'read'][r] AS kind, have = need AND need > 1 AS common FROM b JOIN n USING (module) JOIN h ON h.module = b.module AND h.switch = b.switch""",
)
def t16(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.steering(fixture(spark, "module string, realization string, switch string, kind string", STEERED), _known(spark))


RISKS = [("rich", "acctbal gt 5000", "policy", "abort", 2), ("nation_low", "nation le 5", "policy", "warning", 1), ("none", "acctbal gt 99999", "data", "abort", 2), ("unknown", "acctbal gt 0 and gone_x eq 1", "data", "warning", 1), ("low_or", "nation le 5 or gone_x eq 1", "data", "abort", 3)]


@query(
    "t21_sweep_report",
    f"""WITH {values('r', 'name, text, category, kind, severity', RISKS)}, c AS (SELECT unnest(['rich', 'nation_low', 'none', 'unknown', 'low_or']) AS name, unnest([c_acctbal > 5000, c_nationkey <= 5, c_acctbal > 99999, c_acctbal > 0 AND NULL, c_nationkey <= 5 OR NULL]) AS v FROM customer),
    f AS (SELECT category, kind, severity::VARCHAR AS severity, count(*) FILTER (v) AS holds, count(*) FILTER (v IS NULL) AS undecided FROM c JOIN r USING (name) GROUP BY name, ALL)
    SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS level, coalesce(category, kind, severity) AS value, count(*) AS preconditions,
    count(*) FILTER (holds > 0) AS fired, count(*) FILTER (holds = 0 AND undecided > 0) AS open FROM f GROUP BY GROUPING SETS ((category), (kind), (severity), ())""".replace("GROUP BY name, ALL", "GROUP BY name, category, kind, severity"),
)
def t21(spark: SparkSession, d: str) -> DataFrame:
    """Every precondition against every settings row, counted by category, kind and severity."""
    held = F.create_map(F.lit("acctbal"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    found = K.reach(table(spark, d, "customer").select(held.alias("s")), "s", {name: text for name, text, *_ in RISKS})
    return sweeps.sweep_report(found.join(F.broadcast(fixture(spark, "name string, text string, category string, kind string, severity int", RISKS)), "name"))


@query(
    "j28_target_mentions_subject",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM documents), p AS (SELECT doc_id, doc_id + 1 AS target, words[1] AS subject FROM w WHERE len(words) > 0)
    SELECT p.doc_id, target, subject, w.doc_id IS NOT NULL AS found, coalesce(list_contains(w.words, subject), false) AS mentioned FROM p LEFT JOIN w ON w.doc_id = p.target""",
)
def j28(spark: SparkSession, d: str) -> DataFrame:
    """Every document points to the next one; does that have its first word?"""
    docs = table(spark, d, "documents").select("doc_id", "text")
    said = docs.select("doc_id", (F.col("doc_id") + 1).alias("target"), F.get(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)), 0).alias("subject")).filter("subject is not null")
    return sweeps.mentions(said, docs.filter("text is not null"), "doc_id", "text")
