"""Files to typed tables: symbols, where-used facts, aborts, flags; built on the state of the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceframe.functions.text import identifiers, path_part
from traceframe.operators import source as S

MAX_SNIPPET = 200


def declared_symbols(state: DataFrame) -> DataFrame:
    """Declared symbols with kind, domain, description, place and whether they come with data."""
    found = S.declared_entries(state, S.bracket_rows(state))
    return found.select("*", *[path_part(F.col("path"), k).alias(k) for k in ("module", "realization")])


def flag_rows(state: DataFrame, main: str = "main.gms") -> DataFrame:
    """Compile-time variables that files other than the main one define: path, line, name, value, conditions."""
    pattern = r"(?i)\$\s*set(?:global|local)?\s+(\w+)\s*(.*?)\s*$"
    own = state.filter((F.col("path") != main) & ~F.contains("path", F.lit("standalone/")) & F.col("live") & F.col("line").rlike(pattern))
    value = F.regexp_replace(F.regexp_extract("line", pattern, 2), "^[\"']|[\"']$", "")
    return own.select("path", F.col("n").alias("line"), F.lower(F.regexp_extract("line", pattern, 1)).alias("name"), value.alias("value"), "conditions")


def where_used(state: DataFrame, symbols: DataFrame, switches: DataFrame) -> DataFrame:
    """One row for each (name, code line): role, equation around it, conditions, guards and snippet.

    Names are those declared (sets left out) or switches, looked up with their case.  In a
    declaration only names outside strings count: with data a name is assigned, inside data
    it is read, else declared.  In an equation the role is ``equation``; R files only read.
    """
    names = symbols.filter("kind not like '%set%'").select("name").union(switches.select("name")).distinct()
    live = state.filter((F.col("gms") | F.lower("path").endswith(".r")) & ~F.col("comment") & ~F.col("masked"))
    code = F.substring_index("line", "!!", 1)
    bare = F.when(F.col("declared").isNotNull(), F.regexp_replace(code, "\"[^\"]*\"|'[^']*'", "")).otherwise(code)
    tokens = live.select("path", "n", "line", "gms", "conditions", "guards", "declared", "assigned", "loads", F.posexplode(identifiers(bare)).alias("place", "name"))
    known = tokens.join(names, "name", "left_semi")
    spans = S.equations(state)
    within = known.select("path", "n").distinct().join(spans, "path").filter("n between s and e").groupBy("path", "n").agg(F.min_by("equation", "s").alias("equation"))
    declares = symbols.groupBy("path", F.col("line").alias("n"), "name").agg(F.max("has_data").alias("has_data"))
    in_declaration = F.when(F.col("has_data"), "assigned").when(F.col("has_data").isNull(), "read").otherwise("declared")
    role = F.when(F.col("loads") | F.array_contains("assigned", F.lower("name")), "assigned").otherwise("read")
    return (
        known.join(within, ["path", "n"], "left")
        .join(declares, ["path", "n", "name"], "left")
        .select(
            "name", "path", F.col("n").alias("line"), "place", *[path_part(F.col("path"), k).alias(k) for k in ("module", "realization", "phase")],
            F.col("equation").alias("context"), F.left(F.trim("line"), F.lit(MAX_SNIPPET)).alias("snippet"),
            F.when(~F.col("gms"), "read").when(F.col("declared").isNotNull(), in_declaration).when(F.col("equation").isNotNull(), "equation").otherwise(role).alias("role"),
            "conditions", "guards",
        )
    )
