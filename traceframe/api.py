"""The engine: build a snapshot of a source tree, and ask it.

Views are DataFrames; texts for people are made from them at the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.functions import kleene as K
from traceframe.functions.text import module_matches, query_terms, shorten, unquoted
from traceframe.operators import lineage, search, settings, source, status, sweeps, uses
from traceframe.operators.chunks import file_chunks
from traceframe.plans.scratch import materialize
from traceframe.plans.shipping import ship
from traceframe.sources import readers, snapshot

Embedder = Callable[[DataFrame], DataFrame]
REFERENCES = 10
#: Conditions that are counted in one pass over the configurations.
PAGE = 200


class NotFound(LookupError):
    """Nothing of that name; ``similar`` lists names that contain it."""

    def __init__(self, what: str, similar: list[str]):
        super().__init__(f"{what} was not found" + (f"; similar: {', '.join(similar)}" if similar else ""))
        self.similar = similar


def build_snapshot(
    spark: SparkSession, root: str, out: str, *, files: DataFrame | None = None, scenarios: DataFrame | None = None, model: str = "none",
    embedder: Embedder | None = None, reuse: str | None = None, publish: bool = True,
) -> str:
    """Read the files below ``root`` (or take ``files``: path, text), derive all tables, write and publish them."""
    ship(spark)
    files = readers.source_files(spark, root, extra=["main.cfg"]) if files is None else files
    state = source.line_state(files)
    chunks = file_chunks(files, state)
    ids = F.xxhash64("path", "line_start", "kind")
    header = F.concat_ws("\n", F.concat_ws(", ", "path", F.concat(F.lit("lines "), "line_start", F.lit("-"), "line_end")), F.concat(F.col("kind"), F.lit(" "), F.col("name")))
    chunks = snapshot.keyed(chunks.withColumn("id", ids).withColumn("header", header), model)
    symbols, switches, aborts = uses.declared_symbols(state), source.switches(state), source.aborts(state)
    used = uses.where_used(state, symbols, switches.select("name"))
    used = used.join(state.select("path", F.col("n").alias("line"), "statement"), ["path", "line"])
    texts = used.select(F.explode(F.concat("conditions", "guards")).alias("text")).union(aborts.select(F.explode("conditions"))).union(chunks.select(F.explode("conditions")))
    posted = materialize(search.postings(chunks, "id", {"header": 3.0, "text": 1.0}).repartitionByRange("term").sortWithinPartitions("term"), "postings")
    tables = {
        "chunks": chunks, "symbols": symbols, "switches": switches, "symbol_uses": used, "preconditions": aborts, "flags": uses.flag_rows(state),
        "lines": state.select("path", "n", "line", "ends", "directive", "live", "statement"), "switch_tests": source.switch_tests(state), "conditions": K.parsed(texts), "postings": posted, "index_stats": search.index_stats(posted, "id"),
    }
    if scenarios is not None:
        tables["scenarios"] = settings.inherit(scenarios)
    if embedder is not None:
        tables["vectors"] = snapshot.embed(chunks, snapshot.read(spark, reuse, "vectors") if reuse else None, embedder)
    head = readers.git_head(root) or ""
    path = snapshot.write(spark, out, tables, {"root": root, "commit": head, "model": model})
    if publish:
        snapshot.publish(spark, out, path)
    return path


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return snapshot.read(self.spark, self.path, name)

    def _similar(self, table: str, name: str) -> list[str]:
        return [r.name for r in self.table(table).filter(F.col("name").ilike(f"%{name}%")).select("name").distinct().orderBy("name").limit(10).collect()]

    def _settings(self, scenario: str | None) -> Column:
        """The settings as a literal map: defaults, and what the scenario overrides (a few hundred names)."""
        base = settings.defaults(self.table("switches")).first()
        held = dict(base.settings or {}) if base else {}
        if scenario:
            rows = settings.pick_scenario(self.table("scenarios"), scenario, F.lit(False)).select(settings.normal_cells(F.col("cells")).alias("c")).collect()
            if not rows:
                raise NotFound(f"scenario {scenario}", self._similar("scenarios", scenario))
            held |= {k: v for k, v in rows[0].c.items() if k in held}
        pairs = [F.lit(x) for kv in sorted(held.items()) for x in kv]
        return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(""))

    def search(
        self, query: str, k: int = 5, *, module: str | None = None, realization: str | None = None, kind: str | None = None, phase: str | None = None, mode: str = "hybrid",
        vector: list[float] | None = None, scenario: str | None = None,
    ) -> DataFrame:
        """id, score and chunk of the k best; filters apply after the candidates are ranked.

        With a scenario, chunks of realizations that it does not select are left out, and
        those with a condition that is false under it count for less.
        """
        if mode == "vector" and vector is None:
            raise ValueError("vector search needs the vector of the query: give vector=")
        k = max(1, min(k, 20))
        filtered = any((module, realization, kind, phase))
        n = search.CANDIDATES_FILTERED if filtered else search.CANDIDATES
        chunks = self.table("chunks")
        asked = self.spark.createDataFrame([(1, query)], "q int, text string")
        terms = asked.select("q", F.explode(query_terms(F.col("text"))).alias("raw")).select("q", F.explode(search.tokens(F.col("raw"))).alias("term"))
        rankings = []
        names = asked.select(F.explode(query_terms(F.col("text"))).alias("name"))
        known = names.join(self.table("symbols").select("name").union(self.table("switches").select("name")).distinct(), "name", "left_semi")
        exact = not known.isEmpty()
        if mode != "vector":
            stats = self.table("index_stats").first()
            scored = search.bm25(self.table("postings"), chunks.count(), stats.average, terms, "id", ["q"])
            rankings.append((search.top(scored, ["q"], "id", n), 1.0 if exact or mode == "bm25" else 0.5))
        if mode != "bm25" and vector is not None:
            near = self.table("vectors").join(chunks.select("id", "key"), "key").select(F.lit(1).alias("q"), "id", search.cosine_to(F.col("vector"), vector).alias("score"))
            rankings.append((search.top(near, ["q"], "id", n), 1.0))
        if exact and mode == "hybrid":
            defined = self._definitions(known, chunks)
            rankings.append((defined, 2.0))
        fused = search.fuse(rankings, ["q"], "id").select("id", "score", "rank")
        hits = fused.join(chunks, "id")
        if scenario:
            hits = self._rescored(hits, scenario)
        for column, wanted in (("realization", realization), ("phase", phase)):
            if wanted:
                hits = hits.filter(F.lower(column) == wanted.lower())
        if module:
            hits = hits.filter(module_matches(F.col("module"), F.lit(module)))
        if kind:
            hits = hits.filter(F.col("kind") == kind)
        return hits.orderBy("rank").limit(k)

    def _rescored(self, hits: DataFrame, scenario: str) -> DataFrame:
        held = self._settings(scenario)
        own = hits.filter(F.coalesce(settings.is_selected(F.col("module"), F.col("realization"), held), F.lit(True)))
        each = own.select("id", F.explode("conditions").alias("text")).join(self.table("conditions"), "text")
        false = each.groupBy("id").agg(F.bool_or(~F.coalesce(K.evaluate(F.col("steps"), held), F.lit(True))).alias("false"))
        factor = F.when(F.col("false"), search.OUT_OF_SETTING).otherwise(1.0)
        scored = own.join(false, "id", "left").withColumn("score", F.round(F.col("score") * factor, 9)).drop("false")
        return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank")).cast("bigint"))

    def status(self, chunks: DataFrame, scenario: str | None = None) -> DataFrame:
        """id, place and text of the lines that say whether chunks run under the settings; off conditions with their reach."""
        told = status.chunk_status(chunks, self.table("conditions"), self.table("switch_tests"), self._settings(scenario), scenario or "the defaults")
        equations = status.equation_status(chunks.filter("kind = 'equation'"), self._settings(scenario))
        reasons = equations.select("id", F.lit(900).alias("place"), F.col("condition").alias("text"), (F.col("value").eqNullSafe(F.lit(False))).alias("off"))
        if self._has("scenarios"):
            reasons = status.with_reach(reasons, self.reach(reasons.select("text")))
        return told.unionByName(reasons.select("id", "place", F.concat(F.lit("generated only if "), "text").alias("text")))

    def _has(self, table: str) -> bool:
        return not snapshot.tables(self.spark, self.path).filter(F.col("table") == table).isEmpty()

    def reach(self, texts: DataFrame) -> DataFrame:
        """name (the condition), holds, undecided and configs over all scenario rows; the texts are compiled in pages, each one pass over the rows."""
        asked = sorted(r.text for r in texts.select("text").filter("text is not null").distinct().toLocalIterator())
        base = self._settings(None)
        rows = self.table("scenarios").select(settings.override(base, settings.normal_cells(F.col("cells"))).alias("s"))
        pages = [K.reach(rows, "s", {t: t for t in asked[i : i + PAGE]}) for i in range(0, len(asked), PAGE)]
        return reduce(DataFrame.unionByName, pages) if pages else self.spark.createDataFrame([], "name string, holds bigint, undecided bigint, configs bigint")

    def named_scenarios(self, query: str, main: str = "config/scenarios.csv") -> DataFrame:
        """Scenarios that a query names, the longest names first, three at most."""
        return search.named_scenarios(self.spark.createDataFrame([(1, query)], "q int, text string"), self.table("scenarios"), ["q"], main).drop("q")

    def statement(self, path: str, line: int) -> DataFrame:
        """path, n, start and end of the statement at a line, within the tightest chunk around it."""
        rows = self.table("lines").filter(F.col("path") == path)
        state = rows.select("path", "n", "ends", F.col("directive").alias("barrier"), (F.col("live") & (F.trim("line") != "")).alias("code"))
        spans = self.table("chunks").filter((F.col("path") == path) & F.col("kind").isin("gams_block", "equation")).select("path", F.col("line_start").alias("s"), F.col("line_end").alias("e"))
        return lineage.statements_at(self.spark.createDataFrame([(path, line)], "path string, n int"), state, spans, "path")

    def _definitions(self, known: DataFrame, chunks: DataFrame) -> DataFrame:
        """Ranking of the chunks that define the names: switches, equations, declarations, and interfaces that list them."""
        place = F.when(F.col("kind") == "switch", 0).when(F.col("kind") == "equation", 1).when(F.col("kind") == "declaration", 2).otherwise(4)
        named = chunks.select("id", "kind", F.explode(F.split("name", ", ")).alias("name")).join(known, "name").select("id", "name", place.alias("place"))
        named = named.unionByName(lineage.interface_definitions(chunks, known).select("id", "name", F.lit(3).alias("place")))
        first = named.groupBy("id").agg(F.min(F.struct("name", "place")).alias("first"))
        return first.select(F.lit(1).alias("q"), "id", F.row_number().over(Window.orderBy("first", "id")).cast("bigint").alias("rank"))

    def symbol(self, name: str, *, role: str | None = None, module: str | None = None, offset: int = 0, most: int = 40, scenario: str | None = None) -> dict[str, DataFrame]:
        """Declarations, equations and uses (with marks) of a name."""
        own = F.lower("name") == name.lower()
        declared, used = self.table("symbols").filter(own), self.table("symbol_uses").filter(own)
        if declared.isEmpty() and used.isEmpty():
            raise NotFound(name, self._similar("symbols", name))
        grouped = declared.groupBy("kind", "name", "domain", "description", "module").agg(F.sort_array(F.collect_list(F.struct("path", "line"))).alias("places"))
        marked = self.marked(used, scenario)
        if role:
            marked = marked.filter(F.col("role") == role)
        if module:
            marked = marked.filter(module_matches(F.col("module"), F.lit(module)))
        page = marked.orderBy("rank", "path", "line").offset(offset).limit(most)
        counts = marked.groupBy("role", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") > 0).alias("flagged"))
        equations = self.table("chunks").filter("kind = 'equation'").join(used.filter("context is not null").select(F.col("context").alias("name")).distinct(), "name", "left_semi")
        return {"declarations": grouped, "equations": equations, "conditions": status.equation_status(equations, self._settings(scenario)), "uses": page, "counts": counts, "users": self._users(declared)}

    def _users(self, declared: DataFrame) -> DataFrame:
        """name and users (modules other than the declaring one that use it), the most used first."""
        names = declared.select("name", F.col("module").alias("owner")).distinct()
        used = self.table("symbol_uses").join(names, "name").filter(F.col("module").isNotNull() & ~F.col("module").eqNullSafe(F.col("owner")))
        counted = used.groupBy("name").agg(F.countDistinct("module").alias("users"))
        return names.select("name").distinct().join(counted, "name", "left").select("name", F.coalesce("users", F.lit(0)).alias("users")).orderBy(F.desc("users"), "name")

    def marked(self, used: DataFrame, scenario: str | None = None) -> DataFrame:
        """Uses with mark, rank and reasons under the settings."""
        texts = self.table("conditions")
        rows = used.withColumn("use_id", F.xxhash64("path", "line", "name"))
        tagged = F.concat(F.transform("conditions", lambda t: F.struct(F.lit("ifthen").alias("kind"), t.alias("text"))), F.transform("guards", lambda t: F.struct(F.lit("guard").alias("kind"), t.alias("text"))))
        each = rows.select("use_id", F.posexplode(tagged).alias("i", "t")).select("use_id", "i", "t.*").join(texts, "text")
        tests = each.groupBy("use_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "kind", "text", "steps"))), lambda x: x.dropFields("i")).alias("tests"))
        ready = rows.join(tests, "use_id", "left").withColumn("settings", self._settings(scenario))
        some = ready.filter("tests is not null").select("use_id", "module", "realization", "settings", "tests")
        bare = ready.filter("tests is null and realization is not null").select("use_id", "module", "realization", "settings")
        off = bare.filter(settings.is_selected(F.col("module"), F.col("realization"), F.col("settings")) == F.lit(False)).select("use_id", F.lit(0).alias("place"), F.concat("realization", F.lit(" is not selected")).alias("text"), F.lit(True).alias("off"))
        return rows.join(settings.marks(rows, settings.reasons(some).unionByName(off)), "use_id").drop("use_id")

    def links(self, name: str, most: int = 10) -> dict[str, DataFrame]:
        """One hop: computed from, feeds into, shares equations with, read elsewhere."""
        used = self.table("symbol_uses")
        if used.filter(F.lower("name") == name.lower()).isEmpty():
            raise NotFound(name, self._similar("symbols", name))
        return {
            "computed_from": lineage.computed_from(used, name).limit(most), "feeds_into": lineage.feeds_into(used, name).orderBy(F.desc("statements"), "name").limit(most),
            "in_equations": lineage.in_equations(used, name), "other_reads": lineage.other_reads(used, name),
        }

    def switch(self, name: str, scenario: str | None = None) -> dict[str, DataFrame]:
        """Definition, and the first references of a switch, those that run first."""
        own = F.lower("name") == name.lower()
        found = self.table("switches").filter(own)
        if found.isEmpty():
            raise NotFound(name, self._similar("switches", name))
        chunks = self.table("chunks").filter((F.col("kind") == "switch") & (F.lower("name") == name.lower()))
        allowed = found.select("name", F.explode(F.split("allowed", r"\|")).alias("allowed")).filter("allowed <> ''")
        views = {"config_use": self.config_use(name)} if self._has("scenarios") else {}
        return views | {"definition": found, "documentation": chunks, "allowed": allowed, "references": self.marked(self.table("symbol_uses").filter(own), scenario).orderBy("rank", "path", "line").limit(REFERENCES)}

    def config_use(self, name: str, value: str | None = None) -> DataFrame:
        """Values of a setting over all scenario rows: how many have it, and three of them."""
        key = name.lower()
        base = self._settings(None)
        cells = self.table("scenarios").select("name", settings.normal_cells(F.col("cells")).alias("c"))
        valued = cells.select("name", F.coalesce(F.try_element_at("c", F.lit(key)), F.try_element_at(base, F.lit(key))).alias("value"), F.try_element_at("c", F.lit(key)).isNull().alias("unset"))
        if value is not None:
            valued = valued.filter(F.lower(unquoted(F.col("value"))) == value.lower())
        by = valued.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if("unset").alias("unset"), F.slice(F.sort_array(F.collect_set("name")), 1, 3).alias("examples"))
        return by.orderBy(F.desc("n"), "value")

    def module(self, name: str, realization: str | None = None) -> dict[str, DataFrame]:
        """Realizations, declared symbols, and the names it shares with other modules."""
        own = module_matches(F.col("module"), F.lit(name))
        chunks = self.table("chunks").filter(own)
        if chunks.isEmpty():
            similar = self.table("chunks").filter("module is not null").select("module").distinct().filter(F.col("module").ilike(f"%{name}%"))
            raise NotFound(f"module {name}", [r.module for r in similar.orderBy("module").limit(10).collect()])
        used, declared = self.table("symbol_uses"), self.table("symbols").filter(own)
        if realization:
            declared = declared.filter(F.lower("realization") == realization.lower())
        inside = used.filter(own).select("name").distinct()
        outside = used.filter(~F.coalesce(own, F.lit(False)) & F.col("module").isNotNull()).groupBy("name").agg(F.sort_array(F.collect_set("module")).alias("modules"))
        return {
            "documentation": chunks.filter(F.col("kind").isin("module_doc", "realization_doc")), "selected": self._selected(chunks), "steering": self._steering(used.filter(own)), "symbols_by_use": self._users(declared),
            "realizations": chunks.filter("realization is not null").groupBy("realization").agg(F.count(F.lit(1)).alias("chunks")), "symbols": declared,
            "outputs": declared.select("name").distinct().join(outside, "name"), "inputs": inside.join(declared.select("name"), "name", "left_anti").join(outside, "name"),
        }

    def _selected(self, chunks: DataFrame) -> DataFrame:
        """realization and selected: which of a module's realizations the defaults select."""
        own = chunks.filter("realization is not null").select("module", "realization").distinct()
        return own.select("module", "realization", settings.is_selected(F.col("module"), F.col("realization"), self._settings(None)).alias("selected"))

    def _active(self, known: DataFrame) -> DataFrame:
        """The realizations (module, realization) that the defaults or a scenario select, and those of modules without a setting."""
        base = self._settings(None)
        own = known.withColumn("setting", F.regexp_replace(F.lower("module"), "^[^_]*_", ""))
        chosen = own.select("setting", F.lower(F.try_element_at(base, F.col("setting"))).alias("chosen"))
        unset = own.join(chosen.filter("chosen is null").select("setting").distinct(), "setting", "left_semi")
        if self._has("scenarios"):
            cells = self.table("scenarios").select(F.explode(settings.normal_cells(F.col("cells"))).alias("setting", "value"))
            chosen = chosen.unionByName(cells.select("setting", F.lower("value").alias("chosen")))
        picked = own.withColumn("chosen", F.lower("realization")).join(chosen.distinct(), ["setting", "chosen"], "left_semi")
        return picked.select("module", "realization").unionByName(unset.select("module", "realization"))

    def _steering(self, used: DataFrame) -> DataFrame:
        """Switches that steer the code: per realization the strongest way it depends on each, and whether all active ones do."""
        switch = self.table("switches").select(F.col("name").alias("switch"))
        inside = used.filter("realization is not null")
        tests = lambda column, kind: inside.select("module", "realization", F.explode(column).alias("text"), F.lit(kind).alias("kind"))
        parsed = tests("conditions", "compile").unionByName(tests("guards", "guard")).join(self.table("conditions"), "text")
        tested = parsed.select("module", "realization", "kind", F.explode("steps").alias("s")).select("module", "realization", "kind", F.col("s.name").alias("lower"))
        tested = tested.join(switch.withColumn("lower", F.lower("switch")), "lower").select("module", "realization", "switch", "kind")
        read = inside.join(switch, F.col("name") == F.col("switch")).select("module", "realization", "switch", F.lit("read").alias("kind"))
        active = self._active(inside.select("module", "realization").distinct())
        found = sweeps.steering(tested.unionByName(read), active)
        severity = F.when(F.col("kind") == "compile", 2).when(F.col("kind") == "guard", 1).otherwise(0)
        return found.withColumn("severity", severity).orderBy(F.desc("severity"), "module", "realization", "switch")

    def scenario(self, name: str) -> DataFrame:
        """key, value and default of the settings in which a scenario differs from the defaults."""
        rows = settings.pick_scenario(self.table("scenarios"), name, F.lit(False))
        if rows.isEmpty():
            raise NotFound(f"scenario {name}", self._similar("scenarios", name))
        each = rows.select(F.explode(settings.normal_cells(F.col("cells"))).alias("key", "value"))
        default = F.try_element_at(self._settings(None), F.col("key"))
        return each.withColumn("default", default).filter(~F.lower("value").eqNullSafe(F.lower(unquoted(F.col("default")))))


def render(hits: DataFrame, lines: int = 12) -> list[str]:
    """Found chunks as text: header, and so many lines."""
    shown = F.concat("header", F.lit("\n"), F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n"))
    return [r.shown for r in hits.orderBy("rank").select(shown.alias("shown")).collect()]


def summary(text: Column) -> Column:
    return shorten(text, 220)
