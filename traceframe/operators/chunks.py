"""Chunks of a file: lines to units, units cut at natural places and where too long, small parts packed.

A unit is what a chunk never goes over: a declaration, a switch with what is said about it,
an equation with the comments above it, a run of other lines under the same conditions, a
section of a text.  Within a unit, parts begin at its cuts; a part over the cap is cut again
behind its last blank line, or before the line that does not fit; then a part is packed to
the one before, while that is short and both fit the cap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions import lines as L
from traceframe.functions.scans import running
from traceframe.functions.text import path_part
from traceframe.operators import source as S
from traceframe.operators.packing import chunk_starts, common_conditions
from traceframe.plans.scratch import materialize

#: Characters of a chunk that others are packed to, and at most, by kind; the default comes last.
TARGETS, TARGET = {"declaration": 1_500, "md_section": 1_800, "equation": 0, "switch": 0}, 1_200
CAPS, CAP = {"equation": 12_000}, 2_500
#: Names that a declaration's chunk is called by, at most.
NAMES = 12
DOCS = {"module.gms": "module_doc", "realization.gms": "realization_doc"}
R_SECTION = r"^#+\s.*(?:-{3,}|={3,}|#{3,})\s*$"
# How license lines begin, the prefixes of switches, and the rule that parts their descriptions.
LICENSE = ("*** |", "*** SOF ", "*** EOF ")
SWITCH_PREFIXES, RULE = ("c", "cm"), "-----"
HEADING, FENCE = r"^(#{1,4})\s+(.*?)\s*$", r"^\s*```"


def _in_file(*more: str) -> Window:
    return Window.partitionBy("path", *more).orderBy("n")


def _upto(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _by_kind(values: dict[str, int], default: int) -> Column:
    return reduce(lambda done, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(done), values.items(), F.lit(default))


def is_license(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [line.startswith(x) for x in LICENSE])


def described_switch(line: Column) -> Column:
    """The switch that a comment begins with, in lower case; empty if it begins with none.

    A switch is called after one of the prefixes, or after c and the two digits of a module.
    """
    word = F.regexp_extract(F.ltrim(F.regexp_replace(line, r"^\*+'?", "")), r"^\w+", 0)
    prefix, more = F.substring_index(word, "_", 1), F.length(word) > F.length(F.substring_index(word, "_", 1)) + 1
    of_module = (F.length(prefix) == 3) & prefix.startswith("c") & F.substring(prefix, 2, 2).rlike(r"^\d+$")
    return F.when(line.startswith("*") & more & (prefix.isin(*SWITCH_PREFIXES) | of_module), F.lower(word)).otherwise("")


def is_rule(line: Column) -> Column:
    """A comment that is a rule, by itself or after the mark of documentation."""
    return line.startswith("*" + RULE) | line.startswith("*'" + RULE)


def r_function(line: Column) -> Column:
    """The name that a line assigns a function to; empty if it assigns none."""
    sides = F.split(line, "<-|=", 2)
    name, value = F.trim(F.get(sides, 0)), F.coalesce(F.ltrim(F.get(sides, 1)), F.lit(""))
    is_name = (name != "") & (F.regexp_replace(name, r"[\w.]", "") == "")
    return F.when(is_name & value.rlike(r"^function\b"), name).otherwise("")


def part_starts(items: Column, cap: Column) -> Column:
    """Places (from 0) where a part begins, for items with size, blank and cut: at cuts, and where the cap takes it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("behind"), F.lit(False).alias("blank"), F.lit(0).alias("at"), F.lit(0).alias("place"), F.array(F.lit(0)).alias("starts"))

    def step(a: Column, x: Column) -> Column:
        i, begun = a["at"], a["at"] > F.element_at(a["starts"], -1)
        over = ~x["cut"] & begun & (a["used"] + x["size"] > cap)
        at_blank = over & a["blank"] & (a["place"] < i)
        again = at_blank & (a["behind"] + x["size"] > cap)  # what is left behind the blank line is too long, too
        fresh = (x["cut"] & begun) | (over & ~at_blank) | again
        starts = F.concat(a["starts"], F.when(at_blank, F.array(a["place"])).otherwise(F.array().cast("array<int>")), F.when(fresh, F.array(i)).otherwise(F.array().cast("array<int>")))
        used = F.when(fresh, x["size"]).when(at_blank, a["behind"] + x["size"]).otherwise(a["used"] + x["size"])
        kept = ~fresh & ~at_blank & a["blank"]  # is there still a blank line to cut behind?
        return F.struct(
            used.alias("used"), F.when(x["blank"], F.lit(0).cast("bigint")).otherwise(a["behind"] + x["size"]).alias("behind"), (x["blank"] | kept).alias("blank"),
            (i + 1).alias("at"), F.when(x["blank"], i + 1).otherwise(a["place"]).alias("place"), starts.alias("starts"),
        )

    return F.aggregate(items, zero, step)["starts"]


def packed_starts(sizes: Column, target: Column, cap: Column) -> Column:
    """Places (from 0) of the parts that begin a chunk."""
    return chunk_starts(sizes, lambda used, size: (used < target) & (used + size <= cap))


def cut_units(rows: DataFrame) -> DataFrame:
    """path, kind, name, line_start, line_end and text of the chunks of rows (path, n, line, kind, unit, name, cut); blank edges go."""
    blank = F.trim("line") == ""
    item = F.struct("n", "line", (F.length("line") + 1).cast("bigint").alias("size"), blank.alias("blank"), "cut")
    held = rows.groupBy("path", "kind", "unit").agg(F.min("name").alias("name"), F.sort_array(F.collect_list(item)).alias("items"))
    cut = held.withColumn("starts", part_starts(F.col("items"), _by_kind(CAPS, CAP))).withColumn("before", running(F.transform("items", lambda x: x["size"]), F.lit(0).cast("bigint"), lambda a, x: a + x))
    ends = lambda starts, i: F.coalesce(F.get(starts, i + 1), F.size("items"))
    sized = cut.withColumn("sizes", F.transform("starts", lambda s, i: F.get("before", ends(F.col("starts"), i)) - F.get("before", s)))
    packed = sized.withColumn("chunks", F.transform(packed_starts(F.col("sizes"), _by_kind(TARGETS, TARGET), _by_kind(CAPS, CAP)), lambda k: F.get("starts", k)))
    bounds = packed.select("path", "kind", "name", "items", F.explode(F.transform("chunks", lambda s, i: F.struct(s.alias("s"), ends(F.col("chunks"), i).alias("e")))).alias("b"))
    chunk = bounds.select("path", "kind", "name", F.slice("items", F.col("b.s") + 1, F.col("b.e") - F.col("b.s")).alias("items"))
    full = chunk.withColumn("full", F.filter("items", lambda x: ~x["blank"])).filter(F.size("full") > 0)
    first, last = F.get("full", 0)["n"], F.element_at("full", -1)["n"]
    inner = F.filter("items", lambda x: x["n"].between(first, last))
    return full.select("path", "kind", "name", first.alias("line_start"), last.alias("line_end"), F.array_join(F.transform(inner, lambda x: x["line"]), "\n").alias("text"))


def _source_units(state: DataFrame, main: str) -> DataFrame:
    """Lines of source files with their kind, unit, name and cuts."""
    file = F.substring_index("path", "/", -1)
    rows = state.filter("gms").withColumn("line", F.when(is_license(F.col("line")), "").otherwise(F.col("line")))
    anchors = S.switches(rows, main).select("path", F.col("line").alias("n"), F.col("name").alias("switch"))
    rows = rows.join(anchors, ["path", "n"], "left")
    # A switch has the lines before it, and the comments behind it that speak of no other.
    last = F.last("switch", ignorenulls=True).over(_upto(_in_file()))
    anchor = F.count("switch").over(_upto(_in_file()))
    rows = rows.withColumn("last", last).withColumn("anchor", anchor)
    about = described_switch(F.col("line"))
    other = ((about != "") | is_rule(F.col("line"))) & (about != F.lower("last"))
    breaks = F.col("switch").isNull() & ((~F.col("comment") & (F.trim("line") != "")) | (F.col("comment") & other) | F.col("last").isNull())
    rows = rows.withColumn("broken", F.max(breaks).over(_upto(_in_file("anchor"))))
    assigned = F.max(F.when(F.col("switch").isNotNull(), ~F.col("directive"))).over(Window.partitionBy("path", "anchor"))
    told = F.max(F.when(F.col("switch").isNotNull() | (~F.col("broken") & F.col("comment") & assigned), F.col("n"))).over(Window.partitionBy("path", "anchor"))
    rows = rows.withColumn("belongs", F.col("anchor") + F.when(F.coalesce(F.col("n") <= told, F.lit(False)), 0).otherwise(1)).withColumn("total", F.count("switch").over(Window.partitionBy("path")))
    named = anchors.withColumn("belongs", F.row_number().over(_in_file())).select("path", "belongs", F.col("switch").alias("of"))
    rows = rows.join(named, ["path", "belongs"], "left")
    doc = reduce(lambda done, kv: F.when(file == kv[0], kv[1]).otherwise(done), DOCS.items(), F.lit(None).cast("string"))
    kind = F.when(path_part(F.col("path"), "module").isNotNull() & doc.isNotNull(), doc).when((F.col("total") > 0) & (F.col("belongs") <= F.col("total")), "switch")
    kind = kind.when(F.col("declared").isNotNull() & (F.col("path") != main), "declaration")
    rows = materialize(rows.withColumn("kind", kind), "units")
    # Equations where nothing stands yet, with the comments right above them.
    spans = S.equations(rows.filter("kind is null")).select("path", "s", "e", F.col("equation").alias("eq"))
    within = rows.select("path", "n").join(spans, "path").filter("n between s and e").groupBy("path", "n").agg(F.min_by("eq", "s").alias("eq"), F.min("s").alias("eq_s"))
    rows = rows.join(within, ["path", "n"], "left")
    loose = F.col("kind").isNull() & F.col("eq").isNull() & F.col("comment")
    ahead = F.min(F.when(~loose, F.col("n"))).over(_in_file().rowsBetween(1, Window.unboundedFollowing))
    heads = spans.select("path", F.col("s").alias("ahead"), F.col("eq").alias("above"))
    rows = rows.withColumn("ahead", F.when(loose, ahead)).join(heads, ["path", "ahead"], "left")
    rows = rows.withColumn("eq", F.coalesce("eq", "above")).withColumn("eq_s", F.coalesce("eq_s", F.when(F.col("above").isNotNull(), F.col("ahead"))))
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(F.col("eq").isNotNull(), "equation"), F.lit("gams_block")))
    before = lambda c: F.lag(c).over(_in_file())
    turns = (F.col("kind") == "gams_block") & (~before("kind").eqNullSafe("gams_block") | (before("around") != F.col("around")))
    run = F.sum(turns.cast("int")).over(_upto(_in_file()))
    starts = F.col("comment") & ~F.coalesce(before("comment"), F.lit(False))
    unit = F.when(F.col("kind") == "declaration", F.col("declared")).when(F.col("kind") == "switch", F.col("belongs")).when(F.col("kind") == "equation", F.col("eq_s")).when(F.col("kind") == "gams_block", run).otherwise(0)
    cut = F.when(F.col("kind") == "declaration", starts).when(F.col("kind") == "gams_block", starts | F.coalesce(F.trim(before("line")) == "", F.lit(False))).otherwise(False)
    name = F.when(F.col("kind") == "switch", F.col("of")).when(F.col("kind") == "equation", F.col("eq")).when(F.col("kind") == "module_doc", path_part(F.col("path"), "module"))
    name = name.when(F.col("kind") == "realization_doc", F.concat_ws("/", path_part(F.col("path"), "module"), path_part(F.col("path"), "realization"))).otherwise("")
    return rows.select("path", "n", "line", "kind", unit.cast("bigint").alias("unit"), name.alias("name"), cut.alias("cut"))


def _r_units(lines: DataFrame) -> DataFrame:
    """A file is one unit; parts begin at functions and section headers, with the comments above, and after blank lines."""
    comment = F.ltrim("line").startswith("#")
    head = (r_function(F.col("line")) != "") | F.col("line").rlike(R_SECTION)
    # The comments above a head: what comes next that is no comment, or is a head itself.
    stop = F.min(F.when(~comment | head, F.col("n"))).over(_in_file().rowsBetween(0, Window.unboundedFollowing))
    marked = lines.withColumn("head", head).withColumn("stop", stop)
    heads = marked.filter("head").select("path", F.col("n").alias("stop"), F.lit(True).alias("leads"))
    marked = marked.join(heads, ["path", "stop"], "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    before = lambda c: F.lag(c).over(_in_file())
    cut = F.col("leads") & ~(F.coalesce(before("stop"), F.lit(-1)) == F.col("stop"))
    return marked.select("path", "n", "line", F.lit("r_code").alias("kind"), F.lit(0).cast("bigint").alias("unit"), F.lit("").alias("name"), (cut | F.coalesce(F.trim(before("line")) == "", F.lit(False))).alias("cut"))


def _text_units(lines: DataFrame) -> DataFrame:
    """Sections between headings outside code fences, named by their path of headings."""
    fence = F.col("line").rlike(FENCE)
    open_ = F.coalesce(F.sum(fence.cast("int")).over(_upto(_in_file())), F.lit(0)) % 2 == 1
    level = F.when(~open_ & ~fence & F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1)))
    rows = L.breadcrumbs(lines.withColumn("level", level), "path", F.col("level"), F.regexp_extract("line", HEADING, 2))
    unit = F.count("level").over(_upto(_in_file()))
    return rows.select("path", "n", "line", F.lit("md_section").alias("kind"), unit.alias("unit"), F.col("crumb").alias("name"), F.lit(False).alias("cut"))


def file_chunks(files: DataFrame, state: DataFrame | None = None, main: str = "main.gms") -> DataFrame:
    """path, kind, name, line_start, line_end, text, conditions, module, realization and phase of the chunks of every file.

    The suffix says how a file is cut; one that is none of gms, R, Rmd and md is an error.
    ``conditions`` are those that all code lines of a chunk share.
    """
    suffix = F.lower(F.substring_index("path", ".", -1))
    checked = files.filter("text is not null").withColumn("suffix", F.when(suffix.isin("gms", "r", "rmd", "md"), suffix).otherwise(F.raise_error(F.concat(F.lit("no chunker for "), F.col("path")))))
    state = S.line_state(files.filter(suffix == "gms")) if state is None else state
    plain = L.lines(checked.filter("suffix <> 'gms'"), "path", "text").withColumn("suffix", suffix)
    units = _source_units(state, main).unionByName(_r_units(plain.filter("suffix = 'r'").drop("suffix"))).unionByName(_text_units(plain.filter("suffix in ('md', 'rmd')").drop("suffix")))
    found = materialize(cut_units(units), "chunks")
    entries = S.declared_entries(state, S.bracket_rows(state)).select("path", "line", F.col("name").alias("declares"))
    held = found.filter("kind = 'declaration'").select("path", "kind", "line_start", "line_end").join(entries, "path").filter("line between line_start and line_end")
    listed = held.groupBy("path", "kind", "line_start").agg(F.array_join(F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("line", "declares"))), lambda x: x["declares"])), 1, NAMES), ", ").alias("listed"))
    code = state.filter("not comment and trim(line) <> ''").select("path", "n", "around")
    inside = found.filter("lower(path) like '%.gms'").select("path", "kind", "line_start", "line_end").join(code, "path").filter("n between line_start and line_end")
    shared = common_conditions(inside.select(F.struct("path", "kind", "line_start").alias("chunk"), "n", "around"), "chunk", "n", "around").select("chunk.*", F.col("common").alias("conditions"))
    keys = ["path", "kind", "line_start"]
    functions = F.array_join(F.filter(F.transform(F.split("text", "\n"), r_function), lambda f: f != ""), ", ")
    name = F.when(F.col("kind") == "declaration", F.coalesce("listed", F.lit(""))).when(F.col("kind") == "r_code", functions).otherwise(F.col("name"))
    return found.join(listed, keys, "left").join(shared, keys, "left").select(
        "path", "kind", name.alias("name"), "line_start", "line_end", "text", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"),
        *[path_part(F.col("path"), k).alias(k) for k in ("module", "realization", "phase")],
    )
