"""Comparison of two lists of entries (E07) with the cause of every difference; anchors (T30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import table
from traceframe.operators.alignment import causes
from traceframe.operators.anchors import Anchor, check
from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import parts

TOLERANCE, FAR = 3, 30
#: Lines of an order stand for entries of a file: place is the day, role the flag; the index has some later, and some under another flag.
_REF = "l_quantity > 10"
_IDX = "l_quantity < 45"
_SHIFT = "CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_linenumber END"
_ROLE = "CASE WHEN l_suppkey % 5 = 0 THEN l_linestatus ELSE l_returnflag END"


def _step(number: int, by: str, within: int) -> str:
    """SQL of one pass of two pointers over what the pass before has left."""
    left, group = f"left{number}", f"file, {by}"
    return f"""sides{number} AS (SELECT file, {by} AS role_key, list({{'p': place, 'r': role, 'e': entry, 'f': first}} ORDER BY place, role, entry) FILTER (side = 0) AS a, list({{'p': place, 'r': role, 'e': entry, 'f': first}} ORDER BY place, role, entry) FILTER (side = 1) AS b FROM {left} GROUP BY {group}),
  walk{number} AS (SELECT file, role_key, a, b, 1 AS i, 1 AS j, NULL::BIGINT AS x, NULL::BIGINT AS y FROM sides{number} WHERE a IS NOT NULL AND b IS NOT NULL
    UNION ALL SELECT file, role_key, a, b, CASE WHEN abs(a[i].p - b[j].p) <= {within} OR a[i].p < b[j].p THEN i + 1 ELSE i END, CASE WHEN abs(a[i].p - b[j].p) <= {within} OR a[i].p >= b[j].p THEN j + 1 ELSE j END,
      CASE WHEN abs(a[i].p - b[j].p) <= {within} THEN a[i].f END, CASE WHEN abs(a[i].p - b[j].p) <= {within} THEN b[j].f END FROM walk{number} WHERE i <= len(a) AND j <= len(b)),
  met{number} AS (SELECT 0 AS side, x AS first, y AS partner FROM walk{number} WHERE x IS NOT NULL UNION ALL SELECT 1, y, x FROM walk{number} WHERE x IS NOT NULL),
  left{number + 1} AS (SELECT * FROM left{number} l WHERE NOT EXISTS (SELECT 1 FROM met{number} m WHERE m.side = l.side AND m.first = l.first))"""


_LINES = "(SELECT l_orderkey, l_linenumber, " + ", ".join(f"min({c}) AS {c}" for c in ("l_quantity", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")) + " FROM lineitem GROUP BY 1, 2)"
_DAY = "date_diff('day', DATE '1990-01-01', l_shipdate::DATE)"
_CASCADE = [("same", "role", 0), ("near", "role", TOLERANCE), ("other role", "''", TOLERANCE), ("moved", "role", FAR)]
_SQL = f"""WITH RECURSIVE left1 AS (SELECT 0 AS side, l_orderkey AS file, l_returnflag AS role, {_DAY} AS place, l_orderkey * 10 + l_linenumber AS entry, l_orderkey * 10 + l_linenumber AS first FROM {_LINES} WHERE {_REF}
    UNION ALL SELECT 1, l_orderkey, {_ROLE}, {_DAY} + {_SHIFT}, l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber FROM {_LINES} WHERE {_IDX}),
  {", ".join(_step(i + 1, by, within) for i, (_, by, within) in enumerate(_CASCADE))},
  told AS ({" UNION ALL ".join(f"SELECT side, first AS entry, '{cause}' AS cause, partner FROM met{i + 1}" for i, (cause, _, _) in enumerate(_CASCADE))}
    UNION ALL SELECT side, first, CASE WHEN file NOT IN (SELECT file FROM left1 o WHERE o.side <> l.side) THEN 'unknown file' WHEN side = 0 THEN 'missing' ELSE 'extra' END, NULL FROM left5 l)
  SELECT side, entry, cause, partner FROM told"""


@query("e07_causes", _SQL)
def e07_causes(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of both lists with its counterpart, or the cause why it has none; a line that occurs several times is one entry."""
    columns = ("l_quantity", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns)
    li = rows.repartition(parts(rows.count()), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in columns])
    li = materialize(li.withColumn("day", F.datediff("l_shipdate", F.lit("1990-01-01"))), "lines")
    entry = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry")
    ref = li.filter(_REF).select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("role"), F.col("day").alias("place"), entry)
    idx = li.filter(_IDX).select(F.col("l_orderkey").alias("file"), F.expr(_ROLE).alias("role"), (F.col("day") + F.expr(_SHIFT)).alias("place"), entry)
    return causes(ref, idx, "file", "role", "place", "entry", tolerance=TOLERANCE, far=FAR)


ANCHORS = [
    Anchor("many lines are returned", "lineitem", "l_returnflag = 'R'", 100), Anchor("no line without an order", "lineitem", "l_orderkey is null", 0, 0), Anchor("few lines are large", "lineitem", "l_quantity > 49", 1, 50),
    Anchor("five regions", "region", "true", 5, 5), Anchor("no region is called Atlantis", "region", "r_name = 'ATLANTIS'", 1), Anchor("documents in every language", "documents", "lang = 'en'", 1),
]


@query("t30_anchors", " UNION ALL ".join(f"SELECT '{a.rule}' AS rule, '{a.table}' AS \"table\", n AS found, n BETWEEN {a.least} AND {a.most if a.most is not None else 1 << 60} AS fine FROM (SELECT count(*) AS n FROM {a.table} WHERE {a.predicate})" for a in ANCHORS))
def t30(spark: SparkSession, d: str) -> DataFrame:
    """Known facts of the tables, one aggregate for each table."""
    return check(spark, lambda name: table(spark, d, name), ANCHORS)
