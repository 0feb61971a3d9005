"""Readers on files, Kleene's tables, small operators."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from traceframe.functions import kleene as K
from traceframe.operators import graph, joins
from traceframe.plans.conditions import leaves, parse, switch_only
from traceframe.sources import readers as R


def test_file_tree(spark, tmp_path):
    (tmp_path / "core").mkdir()
    (tmp_path / "output").mkdir()
    (tmp_path / "core/a.gms").write_bytes("é".encode())
    (tmp_path / "core/b.R").write_bytes("é".encode("latin-1"))
    (tmp_path / "core/c.bin").write_bytes(b"x")
    (tmp_path / "output/d.gms").write_bytes(b"x")
    (tmp_path / "main.cfg").write_bytes(b"cfg")
    got = {r.path: r.text for r in R.source_files(spark, str(tmp_path), extra=["main.cfg"]).collect()}
    assert got == {"core/a.gms": "é", "core/b.R": "é", "main.cfg": "cfg"}
    listing = spark.createDataFrame([("core/a.gms",)], "path string")
    files = spark.createDataFrame(list(got.items()), "path string, text string")
    assert R.tracked_only(files, listing).count() == 1 and R.tracked_only(files, None).count() == 3


def test_head_and_staleness(tmp_path):
    assert R.git_head(str(tmp_path)) is None
    (tmp_path / ".git/refs").mkdir(parents=True)
    (tmp_path / ".git/HEAD").write_text("ref: refs/main\n")
    (tmp_path / ".git/refs/main").write_text("abc\n")
    assert R.git_head(str(tmp_path)) == "abc"
    assert R.staleness("abc", "abc") == R.staleness(None, "abc") == "" and "abc" in R.staleness("abc", "def")


def test_exports_and_questions(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"interfaces": [{"module": "a", "name": "v", "direction": "out"}], "not_used": []}))
    assert R.analyser_export(spark, str(tmp_path / "x.json"))["interfaces"].first().name == "v"
    folder = tmp_path / "modules/02_w/x"
    folder.mkdir(parents=True)
    (folder / "not_used.txt").write_text("# comment\nname,type,reason\nvm_x,input,not needed\n")
    row = R.not_used(spark, str(tmp_path / "modules")).first()
    assert (row.name, row.reason, row.module, row.realization) == ("vm_x", "not needed", "02_w", "x")
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "type": "symbol", "question": "?", "gold": ["a"]}]))
    assert R.questions(spark, str(tmp_path / "q.json")).first().gold == ["a"]
    table = R.markdown_table(spark.createDataFrame([(1, "a|b")], "n int, t string"), ["n", "t"]).first().text
    assert table == "| n | t |\n|-|-|\n| 1 | a\\|b |"


def test_kleene_tables(spark):
    three = [True, False, None]
    rows = [(i, *v) for i, v in enumerate(itertools.product(three, three, three))]
    df = spark.createDataFrame(rows, "i int, a boolean, b boolean, c boolean").select("i", F.explode(F.array("a", "b", "c")).alias("v"))
    got = df.groupBy("i").agg(K.kleene_and(F.col("v")).alias("every"), K.kleene_or(F.col("v")).alias("some")).collect()
    for r in got:
        v = rows[r.i][1:]
        assert r.every == (False if False in v else None if None in v else True)
        assert r.some == (True if True in v else None if None in v else False)


def test_leaves_of_conditions():
    assert leaves(parse("a_b eq 1 xor c_d eq 2")) == {"a_b", "c_d"}
    assert switch_only(parse("a_b eq 1 and not c_d eq 2"), {"a_b", "c_d"}) and not switch_only(parse("a_b eq 1 and ord(t) gt 1"), {"a_b"})


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 60: 60}
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_as_of_at_the_same_moment(spark):
    a = spark.createDataFrame([("k", 1), ("k", 5)], "k string, t int")
    b = spark.createDataFrame([("k", 1, "x"), ("k", 4, "y"), ("k", 5, "z")], "k string, t int, v string")
    assert [r.last_v for r in joins.as_of(a, b, "k", "t", "v").orderBy("t").collect()] == [None, "y"]
    assert [r.last_v for r in joins.as_of(a, b, "k", "t", "v", strict=False).orderBy("t").collect()] == ["x", "z"]


@pytest.mark.parametrize("width", [None, 3])
def test_interval_join(spark, width):
    p = spark.createDataFrame([("f", i) for i in range(10)], "k string, n int")
    s = spark.createDataFrame([("f", 2, 4), ("f", 4, 9), ("g", 0, 9)], "k string, s int, e int")
    assert joins.interval_join(p, s, "k", "n", "s", "e", width).count() == 9


def test_stated_defaults_take_the_setting_named_last(spark):
    from traceframe.operators import sweeps

    texts = {
        1: "cm_a_x, whose default value is 9.", 2: "By default cm_a_x is 7", 3: "cm_a_x and cm_b: the default is 5", 4: "cm_a_x: default 4, was 3; cm_b default: off", 5: "cm_b defaults to 'on'.", 6: "the default of cm_a_x is sensible",
        7: "cm_a_x default = 3.0 or 4", 8: "for cm_a_x the default was set to 40 %. And 3 more", 9: "cm_a_x is defaulted to 8; 3 is better", 10: "no setting, default 3", 11: "cm_a_x default, as always", 12: None,
    }
    prose = spark.createDataFrame([("p", n, t) for n, t in texts.items()], "path string, line int, text string")
    held = spark.createDataFrame([("CM_A_X", "3"), ("cm_b", "on")], "name string, value string")
    found = {(r.line, r.name, r.stated) for r in sweeps.stated_defaults(prose, held).collect()}
    assert found == {(1, "cm_a_x", "9.0"), (3, "cm_b", "5.0"), (4, "cm_b", "off"), (8, "cm_a_x", "0.4"), (9, "cm_a_x", "8.0")}


def test_reports_are_written_in_ordered_parts(spark, tmp_path):
    from traceframe.sources import reports

    rows = [(i * 7919 % 5_000, f"a|b\n{i}", None if i % 3 else "x") for i in range(5_000)]
    df = spark.createDataFrame(rows, "n int, t string, u string").repartition(9)
    manifest = reports.write_report(df, str(tmp_path / "r"), ["n", "t", "u"], ["n"], title="All", parts=4)
    assert len(manifest["parts"]) > 1 and sum(p["rows"] for p in manifest["parts"]) == 5_000
    lines = [r.line for r in reports.read_report(spark, str(tmp_path / "r")).orderBy("part", "place").collect()]
    assert lines[:4] == ["# All", "", "| n | t | u |", "|-|-|-|"]
    want = [f"| {n} | {t.replace('|', chr(92) + '|').replace(chr(10), ' ')} | {u or ''} |" for n, t, u in sorted(rows, key=lambda r: r[0])]
    assert lines[4:] == want
    with pytest.raises(FileNotFoundError):
        reports.read_report(spark, str(tmp_path / "none"))


def test_pointers_to_files_that_mention_a_subject(spark):
    from traceframe.operators import sweeps

    files = spark.createDataFrame([("a", "One two_x, three"), ("b", ""), ("c", " ".join(f"w{i}" for i in range(3_000)))], "path string, text string")
    asked = [("a", "TWO_X", True, True), ("a", "two", True, False), ("b", "one", True, False), ("gone", "one", False, False), ("c", "w2999", True, True), ("c", "w3000", True, False), ("a", "one", True, True), ("a", "one", True, True), ("c", None, True, False)]
    pointers = spark.createDataFrame([a[:2] for a in asked], "target string, subject string")
    found = sweeps.mentions(pointers, files, "path", "text", places=16)  # a small signature decides nothing
    assert sorted(map(str, ((r.target, r.subject, r.found, r.mentioned) for r in found.collect()))) == sorted(map(str, asked))
