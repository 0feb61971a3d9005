"""One-hop lineage over a where-used table.

``uses`` has name, path, statement, line, role and (for equations) context.  A statement
is the lines up to a terminator (``functions.lines.statement_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def computed_from(uses: DataFrame, name: str) -> DataFrame:
    """Statements that assign the name, with their inputs in order of mention (none: loaded or constant)."""
    own = uses.filter((F.lower("name") == name.lower()) & (F.col("role") == "assigned")).select("path", "statement").distinct()
    at = F.struct("line", "place") if "place" in uses.columns else F.struct("line")
    inputs = uses.filter("role = 'read'").groupBy("path", "statement", "name").agg(F.min(at).alias("at"))
    listed = inputs.groupBy("path", "statement").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("inputs"))
    return own.join(listed, ["path", "statement"], "left").select("path", "statement", F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"))


def feeds_into(uses: DataFrame, name: str) -> DataFrame:
    """Names assigned by statements that read the name."""
    reads = uses.filter((F.lower("name") == name.lower()) & (F.col("role") == "read")).select("path", "statement").distinct()
    assigned = uses.filter((F.col("role") == "assigned") & (F.lower("name") != name.lower()))
    return assigned.join(reads, ["path", "statement"], "left_semi").groupBy("name").agg(F.countDistinct("path", "statement").alias("statements"))


def in_equations(uses: DataFrame, name: str) -> DataFrame:
    """Other members of the equations that hold the name, in order of mention."""
    eq = uses.filter("role = 'equation' and context is not null").withColumn("eq", F.lower("context"))
    mine = eq.filter(F.lower("name") == name.lower()).select("path", "eq").distinct()
    rest = eq.filter(F.lower("name") != name.lower()).join(mine, ["path", "eq"], "left_semi").groupBy("path", "eq", "name").agg(F.min("line").alias("line"))
    return rest.groupBy("path", F.col("eq").alias("equation")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("members"))


def other_reads(uses: DataFrame, name: str, by: str = "path") -> DataFrame:
    """Reading statements that assign nothing, counted per module or file."""
    assigns = uses.filter("role = 'assigned'").select("path", "statement").distinct()
    own = uses.filter((F.lower("name") == name.lower()) & (F.col("role") == "read"))
    reads = own.select(*dict.fromkeys([by, "path", "statement"])).distinct()
    return reads.join(assigns, ["path", "statement"], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("statements"))


def link_section(entries: DataFrame, most: int, merge: bool = True) -> DataFrame:
    """Entries (rank, path, line, text, why) as shown: merged by (path, why) where allowed, active first.

    At most ``most`` active ones (rank under 2) and max(3, min(most / 2, most - active))
    inactive ones are kept; ``shown`` says which.
    """
    key = ["path", "why", "rank"] if merge else ["path", "why", "rank", "line"]
    first = entries.groupBy(*key).agg(F.min("line").alias("_first"), F.min_by("text", "line").alias("text"), F.sort_array(F.collect_list("line")).alias("lines"))
    active = F.col("rank") < 2
    w = Window.partitionBy(active).orderBy("rank", "path", "_first", "text")
    placed = first.withColumn("place", F.row_number().over(w))
    n = first.agg(F.least(F.lit(most), F.count_if(active)).alias("n"))
    cap = F.when(active, F.lit(most)).otherwise(F.greatest(F.lit(3), F.least(F.lit(most // 2), F.lit(most) - F.col("n"))))
    return placed.join(F.broadcast(n)).withColumn("shown", F.col("place") <= cap).select("rank", "path", F.col("_first").alias("line"), "lines", "text", "why", "shown")


def names_from(members: DataFrame, key: list[str], line: int) -> DataFrame:
    """Names of a statement whose last mention is at or behind a line."""
    return members.groupBy(*key, "name").agg(F.max("line").alias("last")).filter(F.col("last") >= line).drop("last")


#: Lines that a statement is looked for before and behind one of its lines.
MAX_BACK, MAX_FORWARD = 40, 80


def statements_at(points: DataFrame, rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, n, start and end of the statement at each point (key, n).

    ``rows`` has key, n, ends, barrier (a line that statements do not go over) and code (is
    it neither blank nor a comment?); ``spans`` (key, s, e) bound the search, the tightest
    around the point first.  A statement goes back to the line behind the one that ended the
    last, at most MAX_BACK lines, and forward to its own end, at most MAX_FORWARD.
    """
    around = points.join(spans, key).filter("n between s and e").groupBy(key, "n").agg(F.min_by(F.struct("s", "e"), F.struct(F.col("e") - F.col("s"), "s")).alias("b"))
    near = around.select(key, F.col("n").alias("at"), "b.s", "b.e").join(rows, key).filter(
        F.col("n").between(F.greatest("s", F.col("at") - MAX_BACK), F.least("e", F.col("at") + MAX_FORWARD))
    )
    edge = F.max(F.when((F.col("n") < F.col("at")) & (F.col("ends") | F.col("barrier")), F.col("n") + 1))
    found = near.groupBy(key, "at").agg(edge.alias("edge"), F.min("n").alias("low"), F.min(F.when((F.col("n") >= F.col("at")) & F.col("ends"), F.col("n"))).alias("end"), F.max("n").alias("high"), F.collect_list(F.when(F.col("code"), F.col("n"))).alias("code"))
    first = F.greatest(F.coalesce("edge", "low"), "low")
    start = F.array_min(F.filter("code", lambda n: (n >= first) & (n <= F.col("at"))))
    return found.select(key, F.col("at").alias("n"), F.coalesce(start, "at").alias("start"), F.coalesce("end", "high").alias("end"))


def interface_definitions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """name and id of the interface chunks that list a name (one column) as an output: a line of its own that begins with it and a colon."""
    lines = F.split("text", "\n")
    listed = chunks.filter("kind = 'module_interface' and text like 'Outputs of%'").select("id", F.explode(F.slice(lines, F.lit(2), F.size(lines))).alias("line"))
    return listed.select("id", F.substring_index("line", ":", 1).alias("name"), "line").filter(F.contains("line", F.lit(":"))).join(names.select("name").distinct(), "name").select("name", "id").distinct()
