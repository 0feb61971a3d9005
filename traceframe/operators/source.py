"""State of source lines: comments, text blocks, branches, declarations, equations, left sides.

The language has ``*`` comments in the first column, ``!!`` tails, ``$ontext`` blocks,
``$ifthen`` / ``$elseif`` / ``$else`` / ``$endif`` branches for the compiler and
``if( , )`` branches at run time.  Everything is columns, windows over the lines (or the
brackets) of a file and joins within it; a file is the unit of work.

Both kinds of branches are found alike.  Openers and closers are events with a running
depth; the events of one depth between an opener and its closer are a block, each stretch
between two of its events a branch.  A branch holds if its own test does and those of the
branches before do not; a line has the conditions of all branches it stands in, outermost
first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions import lines as L
from traceframe.functions.scans import let, running
from traceframe.plans.scratch import materialize

# The directives, comparisons and declaring words of the language.
DIRECTIVE = r"(?i)^\s*\$\$?(ifthen|elseif|else|endif|if)[ei]?(?:\.\w+)?(?:\s+(.*))?$"
_STRING, _COMPARISON = r"\"[^\"]*\"|'[^']*'", r"(?:==|<>|<=|>=|=|<|>|\b(?:eq|ne|lt|le|gt|ge)\b)"
QUESTIONS = ("exist", "dexist", "set", "setglobal", "setlocal", "setenv", "declared", "defined")
_ANSWER = rf"(?:{_STRING}|\S+)"
_ASKED = rf"(?:{'|'.join(QUESTIONS)})\s+{_ANSWER}"
_COMPARED = rf"(?:{_STRING}|%[^%\s]*%|[^\s\"'%=<>]+)\s*{_COMPARISON}\s*{_ANSWER}"
_ONE_TEST = rf"(?:not\s+)?(?:{_ASKED}|{_COMPARED})"
TEST = rf"(?i)^\s*({_ONE_TEST}(?:\s+(?:and|or)\s+{_ONE_TEST})*)\s*(.*)$"
DECLARATION = r"(?i)^\s*((?:(?:positive|negative|binary|integer|free|nonnegative)\s+)?(?:parameter|scalar|set|variable|equation|table|acronym)s?|alias)(?=[\s\"'(]|$)(.*)$"
LOAD = r"(?i)\b(?:execute_load\w*|loaddc)\b|\$(?:load\w*|gdxin)\b"
_GAP = r"[\s\x05]*"  # a line's end is marked, so that no left side begins behind it
LEFT_SIDE = rf"(?i)(?:^|[;,])\s*([a-z_]\w*){_GAP}(?:\.(?:fx|lo|up|l|m|scale|prior)\b{_GAP})?(?:\${_GAP}[\w.]*{_GAP})*=(?!=)(?![a-z]=)"
EQUATION = r"^\s*([A-Za-z]\w*)\s*(?:\$[^;]*?)?\s*\.\.(?!\.)"
SWITCH_TEST = rf"(?i)(?:[\"']?%(\w+)%[\"']?|\b([a-z]\w*))\s*({_COMPARISON})\s*({_STRING}|[+-]?(?:\d+\.?\d*|\.\d+))"
SETTING = r"(?i)^\s*\$\s*setglobal\s+(\w+)\s*(.*?)\s*(?:!!.*)?$"
PARAMETER = r"^\s*([A-Za-z]\w*)\s*=\s*([^;]*?)\s*;\s*!!.*?\bdef\s*=\s*(.*?)\s*(?:!!.*)?$"
ALLOWED = r"!!\s*regexp\s*=\s*(.*?)\s*(?:!!.*)?$"
ABORT = r"(?i)^\s*\$\$?(?:if[ie]?\s+(.*?)\s+\$?)?abort\b\s*(.*?)\s*;?\s*$"
ABORT_RUN = rf"(?i)\babort\b(?:\s*\$\s*(\((?:[^()]|\([^()]*\))*\)|[\w.%]+))?\s*({_STRING})?"
BRACKET = r"(?i)(?<![\w%.])(?:if\s*\(|elseif\b|else\b)|[(),\[\]]"

#: Lines that a statement is followed over to find its left side, and over which a message is looked for.
JOINED, MESSAGE = 10, 4
_LINE, _END = 1 << 20, (1 << 62)  # places within a file: line number times _LINE, plus the place in the line


def _in_file(*more: str) -> Window:
    return Window.partitionBy("path", *more)


def _upto(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def source_lines(files: DataFrame) -> DataFrame:
    """path, n, line and what a line is: gms, comment, masked (in a text block), live, directive, bare (code without strings), ends."""
    gms = F.lower("path").endswith(".gms")
    rows = L.lines(files.filter("text is not null"), "path", "text").withColumn("gms", gms)
    rows = L.in_block(rows, "path", gms & F.col("line").rlike(r"(?i)^\s*\$ontext\b"), gms & F.col("line").rlike(r"(?i)^\s*\$offtext\b"))
    comment = F.when(gms, L.is_comment(F.col("line"))).otherwise(F.ltrim("line").startswith("#"))
    rows = rows.withColumnRenamed("in_block", "masked").withColumn("comment", comment).withColumn("live", F.col("gms") & ~F.col("comment") & ~F.col("masked"))
    rows = rows.withColumn("bare", F.when(F.col("live"), L.code_part(F.col("line"))).otherwise(""))
    return rows.withColumn("directive", F.col("live") & F.col("line").rlike(r"^\s*\$")).withColumn("ends", F.contains("bare", F.lit(";")))


def split_test(rest: Column) -> Column:
    """test and code: the test behind a directive, and the code that follows it on the line."""
    test = F.regexp_extract(rest, TEST, 1)
    return F.when(test == "", F.struct(F.trim(rest).alias("test"), F.lit("").alias("code"))).otherwise(F.struct(test.alias("test"), F.regexp_extract(rest, TEST, 2).alias("code")))


def without_groups(text: Column) -> Column:
    """The text without its bracket groups, however deep; each round takes the innermost ones, and there are no more rounds than brackets that open."""
    rounds = F.size(F.regexp_extract_all(text, F.lit(r"[(\[]"), F.lit(0)))
    inner = lambda t, _: F.regexp_replace(t, r"\([^()]*\)|\[[^\[\]]*\]", "")
    return F.when(rounds > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), text, inner)).otherwise(text)


def entry_parts(piece: Column) -> Column:
    """name, domain and description of an entry: an identifier, a bracket group right behind it, and a quoted text or what stands before the data."""
    bare = F.ltrim(piece)
    name = F.regexp_extract(bare, r"^[A-Za-z]\w*", 0)
    after = F.ltrim(F.substr(bare, F.length(name) + 1))
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        closed = (c == ")") & (a["depth"] == 1) & (a["end"] == 0)
        return F.struct((a["at"] + 1).alias("at"), (a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), F.when(closed, a["at"] + 1).otherwise(a["end"]).alias("end"))

    end = F.when(after.startswith("("), F.aggregate(F.split(after, ""), state, step)["end"]).otherwise(0)
    rest = F.ltrim(F.substr(after, end + 1))
    quote = F.substring(rest, 1, 1)
    quoted = quote.isin("'", '"') & (F.locate("'", rest, 2) * (quote == "'").cast("int") + F.locate('"', rest, 2) * (quote == '"').cast("int") > 0)
    told = F.when(quoted, F.when(quote == "'", F.substring_index(F.substr(rest, F.lit(2)), "'", 1)).otherwise(F.substring_index(F.substr(rest, F.lit(2)), '"', 1)))
    plain = F.regexp_extract(rest, "^[^/;\"']*", 0)
    return F.struct(name.alias("name"), F.substr(after, F.lit(2), F.greatest(end - 2, F.lit(0))).alias("domain"), F.trim(F.coalesce(told, plain)).alias("description"))


def _levels(events: DataFrame, at: str, opens: Column, closes: Column) -> DataFrame:
    """Adds ``level``: the depth that an event belongs to; closers of nothing have 0."""
    line = _upto(_in_file().orderBy(at))
    summed = events.withColumn("s", F.sum(opens.cast("int") - closes.cast("int")).over(line))
    depth = summed.withColumn("depth", F.col("s") - F.least(F.lit(0), F.min("s").over(line)))
    return depth.withColumn("level", F.when(closes, F.coalesce(F.lag("depth").over(_in_file().orderBy(at)), F.lit(0))).otherwise(F.col("depth"))).drop("s", "depth")


def _condition(kind: Column, first: str, earlier: Column, test: Column) -> Column:
    """Text of a branch's condition: not the earlier tests, and its own in brackets; the first branch has its test as it is."""
    refused = F.transform(earlier, lambda t: F.concat(F.lit("not ("), t, F.lit(")")))
    own = F.when(kind == "else", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("("), test, F.lit(")"))))
    return F.when(kind == first, test).otherwise(F.array_join(F.concat(refused, own), " and "))


def compile_branches(rows: DataFrame) -> DataFrame:
    """path, level, s (line of its directive), e (line of the next one), condition, and whether code stands on line s."""
    word = F.lower(F.regexp_extract("line", DIRECTIVE, 1))
    events = rows.filter(F.col("live") & word.isin("ifthen", "elseif", "else", "endif"))
    events = events.select("path", "n", word.alias("kind"), split_test(F.regexp_extract("line", DIRECTIVE, 2)).alias("t"))
    placed = _levels(events, "n", F.col("kind") == "ifthen", F.col("kind") == "endif").filter("level > 0")
    placed = placed.withColumn("block", F.sum((F.col("kind") == "ifthen").cast("int")).over(_upto(_in_file("level").orderBy("n"))))
    block = _in_file("level", "block").orderBy("n")
    earlier = F.collect_list(F.when(F.col("kind").isin("ifthen", "elseif"), F.col("t.test"))).over(_before(block))
    told = placed.withColumn("earlier", earlier).withColumn("e", F.coalesce(F.lead("n").over(block), F.lit(_END))).filter("kind <> 'endif'")
    return told.select("path", "level", F.col("n").alias("s"), "e", _condition(F.col("kind"), "ifthen", F.col("earlier"), F.col("t.test")).alias("condition"), (F.col("t.code") != "").alias("here"))


def _brackets(code: Column) -> Column:
    """(pos, token) of the words and brackets that run-time branches consist of, and of commas."""

    def placed(found: Column) -> Column:
        steps = F.flatten(F.zip_with(F.slice(F.split(code, BRACKET, -1), F.lit(1), F.size(found)), found, lambda b, m: F.array(F.length(b), F.length(m))))
        return let(running(steps, F.lit(0), lambda a, x: a + x), lambda at: F.transform(found, lambda t, i: F.struct(F.get(at, 2 * i + 1).alias("pos"), F.lower(t).alias("token"))))

    return let(F.regexp_extract_all(code, F.lit(BRACKET), F.lit(0)), placed)


def blanked(line: Column) -> Column:
    """The line cut at its tail, with every string replaced by marks of the same length."""
    marked = F.aggregate(F.regexp_extract_all(line, F.lit(L.STRING), F.lit(0)), line, lambda a, s: F.replace(a, s, F.repeat(F.lit("\u0001"), F.length(s))))
    return F.substring_index(marked, L.TAIL, 1)


def bracket_rows(rows: DataFrame) -> DataFrame:
    """path, n, at, token, kind and level of every bracket, comma and branch word outside strings and directives."""
    tokens = rows.filter(F.col("live") & ~F.col("directive")).select("path", "n", F.explode(_brackets(blanked(F.col("line")))).alias("t"))
    kind = F.when(F.col("t.token").rlike("^if"), "if").when(F.col("t.token").isin("(", "["), "(").when(F.col("t.token").isin(")", "]"), ")").otherwise(F.col("t.token"))
    events = tokens.select("path", "n", (F.col("n").cast("bigint") * _LINE + F.col("t.pos")).alias("at"), "t.token", kind.alias("kind"))
    return _levels(events, "at", F.col("kind").isin("if", "("), F.col("kind") == ")")


def run_branches(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """path, level, block, phase, condition, and the places where the branch's body begins and ends."""
    opens = F.col("kind").isin("if", "elseif", "else")
    events = brackets.filter((F.col("level") > 0) & (F.col("kind") != "("))
    events = events.withColumn("block", F.sum((F.col("kind") == "if").cast("int")).over(_upto(_in_file("level").orderBy("at")))).filter("block > 0")
    block = _in_file("level", "block").orderBy("at")
    events = events.withColumn("closed", F.coalesce(F.sum((F.col("kind") == ")").cast("int")).over(_before(block)), F.lit(0))).filter("closed = 0")
    events = events.withColumn("phase", F.sum(opens.cast("int")).over(_upto(block)))
    keys = ["path", "level", "block", "phase"]
    phases = events.groupBy(*keys).agg(
        F.min_by("kind", "at").alias("kind"), F.min("at").alias("begin"), F.min(F.when(opens, F.col("at") + F.length("token"))).alias("from"),
        F.min(F.when(F.col("kind") == ",", F.col("at"))).alias("comma"), F.min(F.when(F.col("kind") == ")", F.col("at"))).alias("close"),
    )
    by_phase = _in_file("level", "block").orderBy("phase")
    phases = phases.withColumn("until", F.coalesce(F.lead("begin").over(by_phase), "close", F.lit(_END)))
    phases = phases.withColumn("body", F.when(F.col("kind") == "else", F.col("from")).otherwise(F.col("comma") + 1)).filter("body is not null and body <= until")
    phases = materialize(phases, "phases")
    # The text of a test may go over several lines.
    line = lambda at: F.shiftright(F.col(at), 20)
    tested = phases.filter("kind <> 'else'").select(*keys, "from", "comma")
    spread = tested.join(rows.filter("live").select("path", "n", "line"), "path").filter(F.col("n").between(line("from"), line("comma")))
    lo = F.when(F.col("n") == line("from"), F.col("from") % _LINE).otherwise(0)
    hi = F.when(F.col("n") == line("comma"), F.col("comma") % _LINE).otherwise(F.length(blanked(F.col("line"))))
    part = F.substr("line", (lo + 1).cast("int"), (hi - lo).cast("int"))
    text = spread.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", part.alias("part")))).alias("parts"))
    told = text.select(*keys, F.trim(F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["part"]), " "), r"\s+", " ")).alias("test"))
    joined = phases.join(told, keys, "left")
    return joined.select(*keys, "body", "until", _condition(F.col("kind"), "if", F.collect_list("test").over(_before(by_phase)), F.col("test")).alias("condition"))


def line_conditions(rows: DataFrame) -> DataFrame:
    """path, n, and around: the conditions of the compiler's branches around each line that has any."""
    inside = rows.select("path", "n").join(compile_branches(rows), "path").filter("(s < n and n < e) or (s = n and here)")
    held = inside.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("level", "s", "condition"))).alias("all"))
    return held.select("path", "n", F.transform("all", lambda x: x["condition"]).alias("around"))


def line_guards(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """path, n and guards: the run-time conditions of each line that has any.

    A line belongs to a branch if its first character does, or it has code there; one that
    begins with ``else`` or ``elseif`` belongs to what its code stands in.  Several branches
    of one block are joined by or.
    """
    code = F.when(F.col("live") & ~F.col("directive"), blanked(F.col("line"))).otherwise("")
    begin = F.col("n").cast("bigint") * _LINE
    lines = rows.select("path", "n", code.alias("code"), begin.alias("begin"))
    both = lines.join(run_branches(rows, brackets), "path").filter((F.col("begin") < F.col("until")) & (F.col("begin") + _LINE > F.col("body")))
    lo, hi = F.greatest("body", "begin"), F.least(F.col("until"), F.col("begin") + _LINE)
    has_code = F.substr("code", (lo - F.col("begin") + 1).cast("int"), (hi - lo).cast("int")).rlike(r"[^\s);,]")
    fresh = F.col("code").rlike(r"(?i)^\s*(?:else|elseif)\b")
    first = F.col("begin") + F.length("code") - F.length(F.ltrim("code"))
    begins = (F.col("body") <= first) & (first < F.col("until"))
    held = both.filter((begins & ~fresh) | has_code).groupBy("path", "n", "level", "block").agg(F.sort_array(F.collect_list(F.struct("phase", "condition"))).alias("all"))
    one = F.array_distinct(F.transform("all", lambda x: x["condition"]))
    either = F.array_join(F.transform(one, lambda c: F.concat(F.lit("("), c, F.lit(")"))), " or ")
    told = held.select("path", "n", "level", "block", F.when(F.size(one) == 1, F.get(one, 0)).otherwise(either).alias("condition"))
    outermost = told.groupBy("path", "n").agg(F.sort_array(F.collect_list(F.struct("level", "block", "condition"))).alias("all"))
    return outermost.select("path", "n", F.transform("all", lambda x: x["condition"]).alias("guards"))


def left_sides(rows: DataFrame) -> DataFrame:
    """Adds ``assigned`` (names on the left of an assignment that begins on the line, lower case) and ``loads`` (does it load data?).

    A statement that does not end on the line is followed over at most JOINED - 1 more; what
    begins there does not count.  Bracket groups are taken out first, but for those that hold
    statements.
    """
    upcoming = F.collect_list(F.struct("bare", "directive", "ends", "live")).over(_in_file().orderBy("n").rowsBetween(1, JOINED - 1))
    upto = lambda a, flag, more: let(F.array_position(F.transform(a, lambda x: x[flag]), F.lit(True)).cast("int"), lambda k: F.when(k == 0, a).otherwise(F.slice(a, F.lit(1), k - 1 + more)))
    rest = let(upto(F.col("upcoming"), "directive", 0), lambda a: upto(a, "ends", 1))
    joined = F.array_join(F.transform(F.filter(rest, lambda x: x["live"]), lambda x: x["bare"]), " ")
    own = F.when(F.lower(F.regexp_extract("line", DIRECTIVE, 1)) == "if", L.code_part(split_test(F.regexp_extract("line", DIRECTIVE, 2))["code"])).otherwise(F.col("bare"))
    out = rows.withColumn("upcoming", upcoming).withColumn("rest", F.when(F.col("ends") | F.col("directive"), "").otherwise(joined)).withColumn("own", own)
    text = F.regexp_replace(F.regexp_replace(F.col("own"), r"(?i)\b(?:for\s*\(|else\b)", ";"), r"(?i)\b(?:if|elseif|while|loop)\s*\(", "\u0002")
    text = F.concat(text, F.lit("\u0005"), F.regexp_replace("rest", "[;,]", " "))
    text = without_groups(text)
    names = F.transform(F.regexp_extract_all(text, F.lit(LEFT_SIDE), F.lit(1)), F.lower)
    loads = F.col("own").rlike(LOAD) | F.col("rest").rlike(LOAD) | (F.col("live") & F.col("line").rlike(LOAD))
    return out.withColumn("assigned", F.when(F.col("live"), names).otherwise(F.array().cast("array<string>"))).withColumn("loads", F.col("live") & loads).drop("upcoming", "rest", "own")


def statements(rows: DataFrame) -> DataFrame:
    """Adds ``statement`` (how many ended before the line) and ``declared`` (first line of the declaration around it)."""
    numbered = L.statement_id(rows, "path", F.col("ends"))
    opens = F.when(F.col("live") & F.col("line").rlike(DECLARATION), F.col("n"))
    first = F.min(opens).over(_in_file("statement"))
    return numbered.withColumn("declared", F.when(F.col("gms") & (F.col("n") >= first), first))


def equations(rows: DataFrame) -> DataFrame:
    """path, s, e and equation: statements whose head, without its bracket groups, ends in two dots; ``rows`` has statements."""
    code = F.when(F.col("live") & ~F.col("directive") & (F.trim("bare") != ""), F.col("bare"))
    found = rows.filter("gms and declared is null").groupBy("path", "statement").agg(
        F.min(F.when(code.isNotNull(), F.col("n"))).alias("s"), F.max("n").alias("e"), F.sort_array(F.collect_list(F.when(code.isNotNull(), F.struct("n", "bare")))).alias("all")
    )
    text = without_groups(F.array_join(F.transform("all", lambda x: x["bare"]), " "))
    name = F.regexp_extract(text, EQUATION, 1)
    return found.select("path", "s", "e", name.alias("equation")).filter("equation <> ''")


def declared_entries(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """path, line, kind, name, domain, description and has_data of each declared name; ``rows`` has statements.

    An entry stands between commas outside brackets, or begins a line.  Slashes open and
    close lists of data, over lines too, and nothing inside is an entry; a table declares one
    name, and the rest is its body.  Aliases declare nothing.
    """
    commas = brackets.filter("kind = ',' and level = 0").groupBy("path", "n").agg(F.sort_array(F.collect_list((F.col("at") % _LINE).cast("int"))).alias("commas"))
    lines = rows.filter(F.col("declared").isNotNull() & F.col("live") & ~F.col("directive")).join(commas, ["path", "n"], "left")
    opener = F.col("n") == F.col("declared")
    skipped = F.when(opener, F.length("line") - F.length(F.regexp_extract("line", DECLARATION, 2))).otherwise(0)
    cuts = F.concat(F.array(skipped), F.transform(F.filter(F.coalesce("commas", F.array().cast("array<int>")), lambda c: c >= skipped), lambda c: c + 1))
    end = lambda at, i: F.coalesce(F.get(at, i + 1) - 1, F.length(blanked(F.col("line"))))
    pieces = let(cuts, lambda at: F.transform(at, lambda a, i: F.substr(F.col("line"), a + 1, F.greatest(end(at, i) - a, F.lit(0)))))
    kind = F.first(F.when(opener, F.lower(F.regexp_replace(F.trim(F.regexp_extract("line", DECLARATION, 1)), r"\s+", " ")))).over(_in_file("declared").orderBy("n"))
    laid = lines.withColumn("kind", kind).select("path", "n", "declared", "kind", F.posexplode(pieces).alias("i", "piece"))
    slashes = F.length(L.code_part(F.col("piece"))) - F.length(F.replace(L.code_part(F.col("piece")), F.lit("/"), F.lit("")))
    order = _in_file("declared").orderBy("n", "i")
    laid = laid.withColumn("slashes", slashes).withColumn("in_data", F.coalesce(F.sum("slashes").over(_before(order)), F.lit(0)) % 2 == 1)
    laid = laid.withColumn("parts", entry_parts(F.col("piece")))
    name = F.col("parts.name")
    named = laid.withColumn("name", F.when(~F.col("in_data") & (name != "") & (F.col("kind") != "alias"), name))
    named = named.withColumn("entry", F.count("name").over(_upto(order))).filter("entry > 0 and (kind not like 'table%' or entry = 1)")
    data = F.max(F.col("slashes") > 0).over(_in_file("declared", "entry"))
    singular = F.regexp_replace("kind", "(?<=.)s$", "")
    return named.withColumn("has_data", data | F.col("kind").like("table%")).filter("name is not null").select(
        "path", F.col("n").alias("line"), singular.alias("kind"), "name", F.col("parts.domain").alias("domain"), F.col("parts.description").alias("description"), "has_data",
    )


def switches(rows: DataFrame, main: str = "main.gms") -> DataFrame:
    """path, name, value (the default), allowed (a pattern) and line of the switches that the main file sets."""
    found = rows.filter((F.col("path") == main) & F.col("live"))
    by_set, by_value = F.regexp_extract("line", SETTING, 1), F.regexp_extract("line", PARAMETER, 1)
    value = F.regexp_replace(F.when(by_set != "", F.regexp_extract("line", SETTING, 2)).otherwise(F.regexp_extract("line", PARAMETER, 3)), "^[\"']|[\"']$", "")
    return found.filter((by_set != "") | (by_value != "")).select(
        "path", F.when(by_set != "", by_set).otherwise(by_value).alias("name"), value.alias("value"), F.regexp_extract("line", ALLOWED, 1).alias("allowed"), F.col("n").alias("line")
    )


def switch_tests(rows: DataFrame) -> DataFrame:
    """path, n, name, cmp and value of the tests of names against literals, outside comments and strings; each once a line."""
    code = F.when(F.col("live"), L.cut_tail(F.col("line"))).otherwise("")
    message = F.regexp_replace(code, rf"(?<![=<>%]|\beq|\bne)\s+(?:{_STRING})|^(?:{_STRING})(?!\s*[=<>])", " ")  # a string behind no comparison is no value
    parts = F.arrays_zip(*[F.regexp_extract_all(message, F.lit(SWITCH_TEST), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3, 4)])
    flat = rows.select("path", "n", F.explode(parts).alias("t"))
    name = F.lower(F.when(F.col("t.g1") != "", F.col("t.g1")).otherwise(F.col("t.g2")))
    return flat.select("path", "n", name.alias("name"), F.lower("t.g3").alias("cmp"), F.regexp_replace("t.g4", "^[\"']|[\"']$", "").alias("value")).distinct()


def line_state(files: DataFrame) -> DataFrame:
    """All of a line's state, stored: the columns of ``source_lines``, statement, declared, conditions, around, guards, assigned and loads.

    ``around`` are the conditions of the blocks around a line; ``conditions`` also has the
    test of a directive on the line itself that has code behind it.
    """
    rows = materialize(statements(source_lines(files)), "lines")
    brackets = materialize(bracket_rows(rows), "brackets")
    joined = left_sides(rows).join(line_conditions(rows), ["path", "n"], "left").join(line_guards(rows, brackets), ["path", "n"], "left")
    none = F.array().cast("array<string>")
    own = split_test(F.regexp_extract("line", DIRECTIVE, 2))
    single = F.col("live") & (F.lower(F.regexp_extract("line", DIRECTIVE, 1)) == "if") & (own["code"] != "")
    around = F.coalesce("around", none)
    told = joined.withColumn("conditions", F.when(single, F.concat(around, F.array(own["test"]))).otherwise(around)).withColumn("around", around)
    return materialize(told.withColumn("guards", F.coalesce("guards", none)), "state")


def aborts(state: DataFrame) -> DataFrame:
    """path, line, kind, conditions and message of every abort; the message may stand on one of the next lines."""
    text = F.col("line")
    compiled = F.col("directive") & text.rlike(ABORT)
    code = L.cut_tail(text)
    at_run = F.col("live") & ~F.col("directive") & F.col("bare").rlike(r"(?i)\babort\b")
    later = [F.lead(F.regexp_extract("line", f"({_STRING})", 1), k).over(_in_file().orderBy("n")) for k in range(1, MESSAGE)]
    said = F.coalesce(*[F.nullif(x, F.lit("")) for x in (F.regexp_extract(code, ABORT_RUN, 2), F.regexp_extract(code, f"({_STRING})", 1), *later)], F.lit(""))
    test = F.when(compiled, F.regexp_extract(text, ABORT, 1)).otherwise(F.regexp_replace(F.regexp_extract(code, ABORT_RUN, 1), r"^\((.*)\)$", "$1"))
    own = F.when(test == "", F.array().cast("array<string>")).otherwise(F.array(test))
    message = F.when(compiled, F.regexp_extract(text, ABORT, 2)).otherwise(said)
    found = state.withColumn("kind", F.when(compiled, "compile").when(at_run, "run")).withColumn("message", F.trim(F.regexp_replace(message, "^[\"']|[\"' ;]+$", ""))).withColumn("own", own)
    around = F.when(compiled, F.col("around")).otherwise(F.col("conditions"))
    return found.filter("kind is not null").select("path", F.col("n").alias("line"), "kind", F.concat(around, "guards", "own").alias("conditions"), "message")


def block_ends(rows: DataFrame) -> DataFrame:
    """path, n and end: the line that closes the block of each opening, ``else`` or ``elseif`` directive, null if none does."""
    word = F.lower(F.regexp_extract("line", DIRECTIVE, 1))
    events = rows.filter(F.col("live") & word.isin("ifthen", "elseif", "else", "endif")).select("path", "n", word.alias("kind"))
    placed = _levels(events, "n", F.col("kind") == "ifthen", F.col("kind") == "endif").filter("level > 0")
    placed = placed.withColumn("block", F.sum((F.col("kind") == "ifthen").cast("int")).over(_upto(_in_file("level").orderBy("n"))))
    end = F.min(F.when(F.col("kind") == "endif", F.col("n"))).over(_in_file("level", "block"))
    return placed.withColumn("end", end).filter("kind <> 'endif'").select("path", "n", "end")


def block_context(rows: DataFrame) -> DataFrame:
    """path, n and context: the directive of the innermost open branch above each line that stands in one."""
    branches = compile_branches(rows).select("path", "level", "s", "e")
    inside = rows.select("path", "n").join(branches, "path").filter("s < n and n < e").groupBy("path", "n").agg(F.max_by("s", F.struct("level", "s")).alias("s"))
    return inside.join(rows.select("path", F.col("n").alias("s"), F.lower(F.trim("line")).alias("context")), ["path", "s"]).select("path", "n", "context")
