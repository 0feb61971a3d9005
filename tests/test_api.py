"""A snapshot of a small source tree, end to end."""

import pytest
from pyspark.sql import functions as F

from traceframe.api import Engine, NotFound, build_snapshot, render
from traceframe.library.sources import FILES
from traceframe.sources import snapshot
from traceframe.streaming.increments import changed_chunks, windowed_counts

ROWS = [("config/a.csv", 2, "S1", None, {"cm_x": "2", "other": "1"}), ("config/a.csv", 3, "S2", "S1", {"cm_y": "off"})]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("snapshots"))
    files = spark.createDataFrame(FILES, "path string, text string")
    rows = spark.createDataFrame(ROWS, "path string, line int, name string, parent string, cells map<string,string>")
    embed = lambda df: df.select("key", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("vector"))
    path = build_snapshot(spark, "/nowhere", out, files=files, scenarios=rows, embedder=embed)
    assert snapshot.current(spark, out) == path
    return Engine(spark, path)


def test_search_puts_definitions_first(engine):
    hits = engine.search("what is p_z")
    assert "p_z" in hits.first().name
    assert render(hits)[0].startswith(hits.first().header)
    assert engine.search("balance", kind="equation", mode="bm25").count() <= 1
    assert engine.search("text", vector=[100.0, 1.0]).count() > 0


def test_views(engine):
    p_a = engine.symbol("P_A")
    assert p_a["declarations"].first().description == "with data"
    marks = {(r.path, r.line): r.mark for r in p_a["uses"].collect()}
    assert marks["core/presolve.gms", 7] == "✓" and marks["core/presolve.gms", 1] == "✓"
    under = {(r.path, r.line): r.mark for r in engine.symbol("p_a", scenario="s1")["uses"].collect()}
    assert under["core/presolve.gms", 7] == "⚠"
    assert ["p_m", "p_a", "cm_x"] in [r.inputs for r in engine.links("p_z")["computed_from"].collect()]
    assert engine.switch("CM_X")["definition"].first().allowed == "1|2"
    assert {r.key: (r.value, r.default) for r in engine.scenario("S2").collect()} == {"cm_y": ("off", "on"), "cm_x": ("2", "1"), "other": ("1", None)}
    assert [(r.value, r.n) for r in engine.config_use("cm_x").collect()] == [("2", 2)]
    storage = engine.module("12")
    assert storage["realizations"].first().realization == "tank" and storage["selected"].first().selected is None
    assert {(r.switch, r.kind, r.severity) for r in storage["steering"].collect()} == {("cm_y", "compile", 2), ("cm_x", "read", 0)}
    assert [r.name for r in engine.switch("CM_X")["documentation"].collect()] == ["cm_x"] and {r.allowed for r in engine.switch("CM_X")["allowed"].collect()} == {"1", "2"}
    assert [(r.condition, r.value) for r in engine.symbol("q_x")["conditions"].collect()] == [("cm_x eq 2", False)]
    assert {r.name: r.users for r in engine.symbol("p_a")["users"].collect()} == {"p_a": 1}


def test_status_of_hits(engine):
    chunks = engine.table("chunks").filter("kind = 'equation'")
    assert [r.text for r in engine.status(chunks).orderBy("place").collect()] == ['compiled only if "%cm_y%" == "on": holds with the defaults', "generated only if cm_x eq 2; holds in 2 of 2 configurations", "tests of switches, with the defaults: cm_x eq 2 → false"]
    assert {r.text for r in engine.status(chunks, "S2").collect()} == {'compiled only if "%cm_y%" == "on": is off with S2', "tests of switches, with S2: cm_x eq 2 → true"}


def test_search_under_a_scenario(engine):
    plain = {r.id: r.score for r in engine.search("balance p_z q_x", k=20).collect()}
    under = {r.id: (r.score, r.kind) for r in engine.search("balance p_z q_x", k=20, scenario="S2").collect()}
    assert set(plain) == set(under)
    assert all(score == pytest.approx(plain[i] * (0.3 if kind == "equation" else 1.0), abs=1e-6) for i, (score, kind) in under.items())


def test_statements_scenarios_and_tables(engine, spark):
    assert engine.statement("core/presolve.gms", 7).select("start", "end").first()[:] == (6, 7)
    assert [r.name for r in engine.named_scenarios("compare s2 with S1 and S10").collect()] == ["S1", "S2"]
    listed = {(r.table, r.column) for r in snapshot.tables(spark, engine.path).collect()}
    assert {("chunks", "conditions"), ("postings", "tf"), ("lines", "statement"), ("meta", "key")} <= listed


def test_unknown_names_list_similar_ones(engine):
    with pytest.raises(NotFound) as e:
        engine.symbol("p_")
    assert e.value.similar == ["p_a", "p_m", "p_z"]
    with pytest.raises(NotFound):
        engine.scenario("S9")


def test_vectors_are_reused(spark, engine):
    chunks = engine.table("chunks")
    asked = []
    embed = lambda df: (asked.append(df.count()), df.select("key", F.array(F.lit(0.0)).alias("vector")))[1]
    again = snapshot.embed(chunks, engine.table("vectors"), embed)
    assert asked == [0] and again.count() == chunks.select("key").distinct().count()


def test_gate_and_schema_version(spark, engine, tmp_path):
    m = lambda r: spark.createDataFrame([("hybrid", r, 0.7)], "mode string, recall5 double, mrr10 double")
    assert not snapshot.promote(spark, str(tmp_path), engine.path, m(0.8), m(0.7), 0)
    assert not snapshot.promote(spark, str(tmp_path), engine.path, m(0.8), m(0.9), 1)
    assert snapshot.promote(spark, str(tmp_path), engine.path, m(0.8), m(0.8), 0) and snapshot.current(spark, str(tmp_path)) == engine.path
    other = snapshot.write(spark, str(tmp_path), {}, {})
    spark.createDataFrame([("schema_version", "0")], "key string, value string").write.mode("overwrite").parquet(f"{other}/meta")
    with pytest.raises(ValueError):
        snapshot.read(spark, other, "chunks")


def test_increments(spark, tmp_path):
    src, known, out = (str(tmp_path / x) for x in ("in", "known", "out"))
    spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "key string, text string").write.parquet(src)
    spark.createDataFrame([("a",)], "key string").write.parquet(known)
    for _ in range(2):
        changed_chunks(spark, src, "key string, text string", known, out, str(tmp_path / "cp")).awaitTermination()
    assert [r.key for r in spark.read.parquet(out).collect()] == ["b"]
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a'")
    assert windowed_counts(events, "ts", "k").first().n == 2


def test_reach_has_every_condition(engine, spark, monkeypatch):
    from traceframe import api

    monkeypatch.setattr(api, "PAGE", 2)
    texts = [f"cm_x eq {i}" for i in range(5)] + ['"%cm_y%" == "on"', "cm_x eq 2"]
    found = {r.name: (r.holds, r.undecided, r.configs) for r in engine.reach(spark.createDataFrame([(t,) for t in [*texts, None]], "text string")).collect()}
    assert set(found) == set(texts) and found["cm_x eq 2"] == (2, 0, 2) and found["cm_x eq 4"] == (0, 0, 2)


def test_vector_search_says_what_it_lacks(engine):
    with pytest.raises(ValueError, match="vector"):
        engine.search("text", mode="vector")


def test_active_realizations_are_those_that_a_configuration_selects(engine, spark, monkeypatch):
    tables = {"scenarios": spark.createDataFrame([("s", {"water": "cold", "x": "1"}), ("t", {})], "name string, cells map<string,string>")}
    monkeypatch.setattr(Engine, "table", lambda self, name: tables[name])
    monkeypatch.setattr(Engine, "_settings", lambda self, scenario: F.create_map(F.lit("water"), F.lit("Warm")))
    monkeypatch.setattr(Engine, "_has", lambda self, name: True)
    known = spark.createDataFrame([("01_water", "warm"), ("01_water", "cold"), ("01_water", "never"), ("02_free", "a")], "module string, realization string")
    assert sorted(map(tuple, engine._active(known).collect())) == [("01_water", "cold"), ("01_water", "warm"), ("02_free", "a")]


def test_commands(spark, tmp_path, capsys):
    from traceframe.__main__ import main

    for path, text in FILES:
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    out = str(tmp_path / "out")
    assert main(["build", str(tmp_path / "src"), out], spark) == 0
    assert capsys.readouterr().out.strip() == snapshot.current(spark, out)
    assert main(["search", out, "what is p_z", "-k", "2"], spark) == 0
    assert "p_z" in capsys.readouterr().out
    assert main(["show", out, "symbol", "p_a", "--rows", "3"], spark) == 0
    assert "# declarations" in capsys.readouterr().out
    assert main(["show", out, "switch", "no_such_switch"], spark) == 1
    assert "no_such_switch" in capsys.readouterr().err
    assert main(["tables", out], spark) == 0 and '"chunks"' in capsys.readouterr().out
