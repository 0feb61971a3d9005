"""Consistency sweeps: preconditions, prose, module coupling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceframe.functions import kleene as K
from traceframe.functions.text import normal_value, same_value
from traceframe.operators.graph import connected_components
from traceframe.plans.scratch import materialize

#: A value that equals no other.
IMPOSSIBLE = "\u0001"


def severity(aborts: DataFrame, defaults: Column, settings: list[str]) -> DataFrame:
    """Adds ``severity``: rows (id, conditions, problems = settings whose tests cannot hold).

    ``-`` unless there are conditions and all are tests of settings alone.  With problems
    those settings equal nothing and all others are unknown: impossible if the conditions
    then hold, a dead check if not, suspicious if that is open.  Else the defaults decide.
    """
    names = F.array(*[F.lit(n) for n in settings])
    each = aborts.select("id", "problems", F.explode("conditions").alias("text"))
    parsed = each.join(K.parsed(each), "text")
    own = F.forall("steps", lambda s: s["op"].isin("and", "or", "not") | (s["op"].isin("sw", "sw2", "def") & F.coalesce(F.array_contains(names, s["name"]), F.lit(False))))
    bad = F.map_from_arrays("problems", F.transform("problems", lambda p: F.lit(IMPOSSIBLE)))
    valued = parsed.select("id", own.alias("own"), K.evaluate(F.col("steps"), bad).alias("by_problem"), K.evaluate(F.col("steps"), defaults).alias("by_default"))
    by = valued.groupBy("id").agg(F.bool_and("own").alias("own"), K.kleene_and(F.col("by_problem")).alias("p"), K.kleene_and(F.col("by_default")).alias("v"))
    joined = aborts.join(by, "id", "left")
    text = (
        F.when(~F.coalesce("own", F.lit(False)), "-")
        .when((F.size("problems") > 0) & F.col("p"), "impossible").when((F.size("problems") > 0) & ~F.col("p"), "dead check").when(F.size("problems") > 0, "suspicious")
        .when(F.col("v"), "aborts by default").when(~F.col("v"), "ok").otherwise("depends")
    )
    return joined.withColumn("severity", text).drop("own", "p", "v")


def close_names(unknown: DataFrame, known: DataFrame, least: float = 0.7, n: int = 2) -> DataFrame:
    """name and ``close``: up to n known names that begin with the same two characters and need few edits for their length."""
    names, others = unknown.select("name").distinct(), known.select(F.col("name").alias("known")).distinct()
    both = names.join(others, F.left("name", F.lit(2)) == F.left("known", F.lit(2)))
    likeness = 1 - F.levenshtein("name", "known") / F.greatest(F.length("name"), F.length("known"))
    best = Window.partitionBy("name").orderBy(F.desc("likeness"), "known")
    placed = both.withColumn("likeness", likeness).filter(F.col("likeness") >= least).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)
    held = placed.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "known"))), lambda x: x["known"]).alias("close"))
    return names.join(held, "name", "left").select("name", F.coalesce("close", F.array().cast("array<string>")).alias("close"))


def coupling(owners: DataFrame, uses: DataFrame) -> DataFrame:
    """owner, user and the phases in which the user reads or writes the owner's symbols; own uses are left out."""
    joined = uses.join(owners, "symbol").filter("owner <> user")
    return joined.groupBy("owner", "user").agg(F.array_join(F.array_sort(F.collect_set("phase")), "+").alias("phases"), F.countDistinct("symbol").alias("symbols"), F.bool_or(F.col("role") == "assigned").alias("writes"))


def reachable(edges: DataFrame, most: int = 64, nodes: int = 10_000) -> DataFrame:
    """src, dst of all pairs joined by a path, for a small graph: squaring until nothing is new (log2 of the diameter).

    The result may have as many rows as there are pairs, so a graph of more nodes than given is refused.
    """
    pairs = materialize(edges.select("src", "dst").distinct(), "pairs")
    if (held := pairs.select("src").union(pairs.select("dst")).distinct().count()) > nodes:
        raise ValueError(f"{held} nodes are too many for all pairs; strong_components and weak_components take any graph")
    n = pairs.count()
    while most > 0:
        more = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        pairs = materialize(pairs.union(more).distinct(), "pairs")
        if (grown := pairs.count()) == n:
            break
        n, most = grown, most - 1
    return pairs


def _spread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and color: the smallest node that reaches it, itself included; a round for each step of the longest way."""
    colors = materialize(nodes.select("node", F.col("node").alias("color")), "colors")
    while True:
        met = edges.join(colors, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("met"))
        after = colors.join(met, "node", "left").select("node", F.least("color", F.coalesce("met", "color")).alias("color"), (F.col("met") < F.col("color")).alias("moved"))
        after = materialize(after, "colors")
        colors = after.select("node", "color")
        if after.filter("moved").isEmpty():
            return colors


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the strongly connected components of more than one node.

    Forward and backward colouring: every node takes the smallest node that reaches it, and
    those of its colour that reach that node, backwards, are its component.  They leave with
    their edges, and the rest is coloured anew.  Tables hold nodes and edges, never pairs.
    """
    live = materialize(edges.select("src", "dst").filter("src <> dst").distinct(), "live")
    found: list[DataFrame] = []
    while not live.isEmpty():
        nodes = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
        colors = _spread(nodes, live)
        inside = live.join(colors.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst").filter("a = b")
        inside = materialize(inside.select("src", "dst"), "inside")
        held = materialize(colors.filter("node = color"), "held")
        front = held
        while not front.isEmpty():  # one step backwards at a time
            before = inside.join(front.select(F.col("node").alias("dst"), "color"), "dst").select(F.col("src").alias("node"), "color").distinct()
            front = materialize(before.join(held, "node", "left_anti"), "front")
            held = materialize(held.union(front), "held")
        found.append(held)
        gone = held.select("node")
        live = materialize(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "live")
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).filter("false")
    every = reduce(DataFrame.union, found)
    large = every.groupBy("color").count().filter("count > 1").select("color")
    return every.join(large, "color").select("node", F.col("color").alias("component"))


def weak_components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def _matches(prose: DataFrame, pattern: str) -> DataFrame:
    """path, line and m (first and second group) of every match of a pattern with two groups, not only of a line's first."""
    groups = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(name) for i, name in ((1, "first"), (2, "second"))])
    return prose.select("path", "line", F.explode(groups).alias("m"))


def stated_defaults(prose: DataFrame, settings: DataFrame) -> DataFrame:
    """path, line, name, stated and value where prose (path, line, text) states another default than is set (name, value).

    Each mention of a default speaks of the setting that was named last before it, and
    states the first word behind it, if that can be a value: quoted, with a digit, on, off
    or none, or behind "to", a colon or an equals sign.  It is right if that word, or any
    number of the clause up to a semicolon or the end of the sentence, is the value set.
    """
    parts = F.split("text", r"(?i)\bdefault(?:s|ed)?\b", -1)
    mentions = prose.select("path", "line", parts.alias("parts")).filter(F.size("parts") > 1).select("path", "line", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("i"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("i")), " ")
    after = F.regexp_replace(F.get("parts", F.col("i")), r"(?i)^\s+values?\b", "")
    told = mentions.select("path", "line", "i", F.regexp_extract_all(F.lower(before), F.lit(r"\w+"), F.lit(0)).alias("words"), after.alias("after"))
    lead = r"(?i)^\s*(?:(?:is|was|of)\b\s*)?(?:set\s+)?(?:(to\b|[:=])\s*)?(?:is\b\s*)?"
    word = F.regexp_extract("after", lead + "(\"[^\"]*\"|'[^']*'|[^\\s\"',;:()]*[^\\s\"',;:().](?:\\s+%)?)", 2)
    told = told.withColumn("stated", word).withColumn("signed", F.regexp_extract("after", lead, 1) != "")
    quoted = F.substring("stated", 1, 1).isin("'", '"')
    told = told.filter((F.col("stated") != "") & (quoted | F.col("stated").rlike(r"\d") | F.lower("stated").isin("on", "off", "none") | F.col("signed")))
    clause = F.regexp_extract("after", r"^(?:[^.;]|\.(?!\s|$))*", 0)
    numbers = F.transform(F.regexp_extract_all(clause, F.lit(r"[-+]?\d[\d.eE+-]*%?"), F.lit(0)), lambda x: normal_value(x))
    said = told.select("path", "line", "i", normal_value(F.col("stated")).alias("stated"), numbers.alias("numbers"), F.posexplode("words").alias("at", "name"))
    held = settings.select(F.lower("name").alias("name"), normal_value(F.col("value")).alias("value"))
    last = said.join(held, "name").groupBy("path", "line", "i").agg(F.max_by(F.struct("name", "stated", "numbers", "value"), "at").alias("x")).select("path", "line", "x.*")
    right = same_value(F.col("stated"), F.col("value")) | F.exists("numbers", lambda x: F.coalesce(same_value(x, F.col("value")), F.lit(False)))
    return last.filter(~right).select("path", "line", "name", "stated", "value")


def sweep_report(found: DataFrame) -> DataFrame:
    """level, value, preconditions, fired and undecided of a sweep (category, kind, severity, holds, undecided), by each of the three and over all, in one pass."""
    sums = [F.count(F.lit(1)).alias("preconditions"), F.count_if(F.col("holds") > 0).alias("fired"), F.count_if((F.col("holds") == 0) & (F.col("undecided") > 0)).alias("open")]
    columns = [F.col(c) for c in ("category", "kind", "severity")]
    told = found.withColumn("severity", F.col("severity").cast("string")).groupingSets([[c] for c in columns] + [[]], *columns).agg(*sums, F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "kind").when(F.col("g") == 6, "severity").otherwise("all")
    return told.select(level.alias("level"), F.coalesce("category", "kind", "severity").alias("value"), "preconditions", "fired", "open")


def lost_pointers(prose: DataFrame, files: DataFrame) -> DataFrame:
    """path, line and pointer where prose names a source file that does not exist, as it stands or below modules/."""
    pattern = r"\b((?:[\w-]+/)+[\w-]+\.(?:gms|R|md))\b"
    said = prose.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pointer"))
    known = files.select(F.col("path").alias("pointer")).union(files.filter("path like 'modules/%'").select(F.regexp_replace("path", "^modules/", ""))).distinct()
    return said.join(known, "pointer", "left_anti").select("path", "line", "pointer")


def mentions(pointers: DataFrame, files: DataFrame, path: str, text: str, places: int = 2_048) -> DataFrame:
    """``pointers`` (with target and subject) and ``found``, whether the target exists, and ``mentioned``, whether its text has the subject as a word.

    A file's signature is the set of its words' hashes, folded to ``places``.  A pointer
    whose subject is not in it is answered by the signature alone; only the others meet the
    text, so the answers are exact and few texts are moved.
    """
    fold = lambda word: F.pmod(F.xxhash64(F.lower(word)), F.lit(places)).cast("smallint")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)))
    signed = files.select(F.col(path).alias("target"), F.array_distinct(F.transform(words, fold)).alias("signature"))
    asked = pointers.withColumn("asked", F.monotonically_increasing_id())
    asked = materialize(asked.join(signed, "target", "left").withColumn("found", F.col("signature").isNotNull()).withColumn("likely", F.coalesce(F.array_contains("signature", fold(F.col("subject"))), F.lit(False))).drop("signature"), "probed")
    likely = asked.filter("likely").select("asked", "target", "subject")
    texts = files.join(likely.select(F.col("target").alias(path)).distinct(), path, "left_semi").select(F.col(path).alias("target"), words.alias("words"))
    exact = likely.join(texts, "target").filter(F.array_contains("words", F.lower("subject"))).select("asked", F.lit(True).alias("mentioned"))
    return asked.join(exact, "asked", "left").withColumn("mentioned", F.coalesce("mentioned", F.lit(False))).drop("asked", "likely")


def unknown_realizations(prose: DataFrame, known: DataFrame) -> DataFrame:
    """path, line, module and realization where prose sets a module to a realization that it has not (known: module, realization)."""
    pattern = r"\b([A-Za-z]\w*)\s*=\s*[\"']?([A-Za-z]\w*)"
    said = _matches(prose, pattern).select("path", "line", F.lower("m.first").alias("module"), F.col("m.second").alias("realization"))
    modules = known.select(F.lower(F.regexp_replace("module", "^[^_]*_", "")).alias("module"), "realization")
    own = said.join(modules.select("module").distinct(), "module", "left_semi")
    return own.join(modules, ["module", "realization"], "left_anti").select("path", "line", "module", "realization")


def message_issues(aborts: DataFrame, known: DataFrame) -> DataFrame:
    """Aborts (id, module, realization, message) whose message names another realization of the same module."""
    words = aborts.select("id", "module", "realization", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"[A-Za-z]\w*"), F.lit(0)))).alias("named"))
    others = known.select("module", F.col("realization").alias("named"))
    return words.join(others, ["module", "named"]).filter("named <> realization").select("id", "named")


def steering(uses: DataFrame, active: DataFrame) -> DataFrame:
    """module, realization, switch, kind (strongest of compile, guard, read) and whether all active realizations use it."""
    rank = F.when(F.col("kind") == "compile", 0).when(F.col("kind") == "guard", 1).otherwise(2)
    by = uses.join(active, ["module", "realization"], "left_semi").groupBy("module", "realization", "switch").agg(F.min(rank).alias("rank"))
    need = active.groupBy("module").agg(F.countDistinct("realization").alias("need"))
    shared = by.groupBy("module", "switch").agg(F.countDistinct("realization").alias("have")).join(need, "module").select("module", "switch", ((F.col("have") == F.col("need")) & (F.col("need") > 1)).alias("common"))
    return by.join(shared, ["module", "switch"]).select("module", "realization", "switch", F.element_at(F.array(F.lit("compile"), F.lit("guard"), F.lit("read")), F.col("rank") + 1).alias("kind"), "common")
