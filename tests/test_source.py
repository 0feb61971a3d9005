"""State of source lines, chunks and where-used facts, on texts of their own."""

import random

import pytest
from pyspark.sql import functions as F

from traceframe.operators import chunks as C
from traceframe.operators import source as S
from traceframe.operators import uses as U


@pytest.fixture(scope="module")
def state(spark):
    def make(*texts):
        return S.line_state(spark.createDataFrame([(f"f{i}.gms", t) for i, t in enumerate(texts)], "path string, text string"))

    return make


def _column(state, name, path="f0.gms"):
    return [r[name] for r in state.filter(F.col("path") == path).orderBy("n").select("n", name).collect()]


def test_branches_of_the_compiler(state):
    text = "$ifthen.outer %mode% == 'fast'\nx\n$ifthenI %level% == 3 y\nz\n$else\nw\n$endif\n$elseif.outer set fallback\nv\n$else\nu\n$endif.outer\nt\n$endif\n$if not %mode% == 'slow' s = 1;\nr\n"
    fast, level = "%mode% == 'fast'", "%level% == 3"
    other = f"not ({fast}) and (set fallback)"
    neither = f"not ({fast}) and not (set fallback)"
    assert _column(state(text), "conditions") == [
        [], [fast], [fast, level], [fast, level], [fast], [fast, f"not ({level})"], [fast], [], [other], [], [neither], [], [], [], ["not %mode% == 'slow'"], [],
    ]


def test_guards_at_run_time(state):
    text = "if(k_on eq 1,\n u = 1;\nelseif k_mode eq 2 or k_mode eq 5,\n if(k_deep > 7,\n  v = f(1, 2);\n );\nelse\n w = 1;\n);\nt = 1;\nif(k_on eq 1, u = 1; else u = 2;);\n* if(q,\ndisplay 'if(q,';\ns = 1; !! if(q,\nif((u(\"a\") = 0) and\n  v(t, r) > 1,\n z = 1;\n);\n"
    second = "not (k_on eq 1) and (k_mode eq 2 or k_mode eq 5)"
    assert _column(state(text), "guards") == [
        [], ["k_on eq 1"], [], [second], [second, "k_deep > 7"], [second], [], ["not (k_on eq 1) and not (k_mode eq 2 or k_mode eq 5)"], [], [],
        ["(k_on eq 1) or (not (k_on eq 1))"], [], [], [], [], [], ['(u("a") = 0) and v(t, r) > 1'], [],
    ]


def _branches(rng, depth=0):
    """A random nest of branches: lines with the conditions that they have by construction."""
    out = []
    for _ in range(rng.randint(1, 3)):
        if depth < 3 and rng.random() < 0.5:
            tests = [f"%s{rng.randint(0, 9)}% == {rng.randint(0, 9)}" for _ in range(rng.randint(1, 3))]
            for i, test in enumerate(tests):
                own = test if i == 0 else " and ".join([*(f"not ({t})" for t in tests[:i]), f"({test})"])
                out.append((f"${'ifthen' if i == 0 else 'elseif'} {test}", []))
                out += [(line, [own, *c]) for line, c in _branches(rng, depth + 1)]
            if rng.random() < 0.5:
                out.append(("$else", []))
                out += [(line, [" and ".join(f"not ({t})" for t in tests), *c]) for line, c in _branches(rng, depth + 1)]
            out.append(("$endif", []))
        else:
            out.append((f"x{rng.randint(0, 99)} = 1;", []))
    return out


def test_random_nests_of_branches(state):
    rng = random.Random(7)
    files = [_branches(rng) for _ in range(25)]
    got = state(*["\n".join(line for line, _ in f) for f in files])
    held = {}
    for r in got.orderBy("path", "n").collect():
        held.setdefault(r.path, []).append(r.conditions)
    assert all(held[f"f{i}.gms"] == [c for _, c in f] for i, f in enumerate(files))


def test_stray_directives_do_no_harm(state):
    assert _column(state("$endif\n$else\na = 1;\n$ifthen %x% == 1\nb = 1;\n"), "conditions") == [[], [], [], [], ["%x% == 1"]]
    assert _column(state(");\na = 1;\nif(k eq 1,\nb = 1;\n"), "guards") == [[], [], [], ["k eq 1"]]


def test_text_blocks_and_comments(state):
    s = state("a = 1;\n  $onText\nb = 2;\n  $offText\nc = 3;\n$ontextual\nd = 4;\n * not a comment\n")
    assert _column(s, "masked") == [False, True, True, True, False, False, False, False]
    assert _column(s, "ends")[:3] == [True, False, False] and not any(_column(s, "comment"))


LEFT_SIDES = [
    ("k(t) = 1;", ["k"]), ("k.lo(t) = 1;", ["k"]), ("m = k(t);", ["m"]), ("if(k = 1, m = 2;);", ["m"]), ("e(t).. k =e= 1;", []), ("k(t)$(m = 1) = 2;", ["k"]), ("k(t,r(t))$m(t)$(n = 1) = 2;", ["k"]),
    ('$if %a% == "b" k = 1;', ["k"]), ("for (k = 1 to 3,", ["k"]), ("k = 1; M = 2;", ["k", "m"]), ("loop(t, k(t) = 1;);", ["k"]), ("k(t)\n* note\n = 1;", ["k"]), ("k(t)\n  * m(t);", []),
    ("k == 1;", []), ('display "k = 1";', []), ("if(k eq 1,\n k = 2;", []),
]


def test_left_sides(state):
    s = state(*[text for text, _ in LEFT_SIDES])
    first = {r.path: r.assigned for r in s.filter("n = 1").collect()}
    assert [first[f"f{i}.gms"] for i in range(len(LEFT_SIDES))] == [names for _, names in LEFT_SIDES]


def test_loading_counts_as_assigning(state):
    assert _column(state("Execute_Loadpoint 'in' k = k;\nk = 1;\n$gdxin f\n"), "loads") == [True, False, True]


def test_declarations(state):
    text = (
        "parameters\n k_a, k_b the text\n k_c(t,r(t)) \"x, y\" / 1 2, 3 4 /, k_d\n/ 5 6 /\n;\ntable k_t(t,r) 'tab'\n  a b\n1 2 3;\nset s_t \"time\" / a, b\n c /;\nalias(s_t, s_u);\npositive variables v_x(t), v_y;\nsets_x(t) = yes;\n"
        "* parameter in a comment\nScalar;\n"
    )
    s = state(text)
    found = S.declared_entries(s, S.bracket_rows(s)).collect()
    assert sorted((r.line, r.name, r.kind, r.domain, r.description, r.has_data) for r in found) == [
        (2, "k_a", "parameter", "", "", False), (2, "k_b", "parameter", "", "the text", False), (3, "k_c", "parameter", "t,r(t)", "x, y", True), (3, "k_d", "parameter", "", "", True),
        (6, "k_t", "table", "t,r", "tab", True), (9, "s_t", "set", "", "time", True), (12, "v_x", "positive variable", "t", "", False), (12, "v_y", "positive variable", "", "", False),
    ]
    assert _column(s, "declared")[12] is None


def test_equations(state):
    s = state("* x\ne_a(s(t),r)$(k eq (1))..\n  a =e= b\n;\ne_b..\n a =e= b;\ne_c(t)\n  $(f(a,b))\n  ..  x =g= 1;\nk = 1 ...;\nequation e_d(t) \"y\";\ne_f(t)$k.. x =l= 2;\n")
    assert sorted((r.s, r.e, r.equation) for r in S.equations(s).collect()) == [(2, 4, "e_a"), (5, 6, "e_b"), (7, 9, "e_c"), (12, 12, "e_f")]


def test_aborts_and_switch_tests(state):
    s = state("$ifthen %x% == 'a'\n$abort 'bad x'\n$endif\nif(k eq 1,\nabort\n \"no k\";\n);\n$if %z% == \"1\" $abort \"bad z\"\nabort$(card(m) > 1) \"many\";\n* abort\n")
    found = sorted((a.line, a.kind, a.conditions, a.message) for a in S.aborts(s).collect())
    assert found == [(2, "compile", ["%x% == 'a'"], "bad x"), (5, "run", ["k eq 1"], "no k"), (8, "compile", ['%z% == "1"'], "bad z"), (9, "run", ["card(m) > 1"], "many")]
    s = state("* k_a eq 1\nk_b eq .5 !! k_c eq 3\n%kd% == 'x'\nif(k_e ne 9, abort \"needs k_f = 2\");\n'%k_g%' <> 'y'\n")
    assert sorted((r.n, r.name, r.cmp, r.value) for r in S.switch_tests(s).collect()) == [(2, "k_b", "eq", ".5"), (3, "kd", "==", "x"), (4, "k_e", "ne", "9"), (5, "k_g", "<>", "y")]


def _starts(sizes, blanks, cuts, cap):
    """Parts by the rule, looking at the whole part each time."""
    out, begin = [0], 0
    for i, size in enumerate(sizes):
        if cuts[i] and i > begin:
            begin = i
            out.append(i)
        while i > begin and sum(sizes[begin : i + 1]) > cap:
            at = max((k + 1 for k in range(begin, i) if blanks[k]), default=i)
            begin = at
            out.append(at)
    return out


def test_parts_and_packing_follow_the_rule(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        n = rng.randint(1, 60)
        sizes, blanks = [rng.randint(1, 50) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]
        rows.append((k, [{"size": 1 if b else x, "blank": b, "cut": rng.random() < 0.05} for x, b in zip(sizes, blanks, strict=True)]))
    df = spark.createDataFrame(rows, "k int, items array<struct<size:bigint,blank:boolean,cut:boolean>>")
    got = {r.k: r.s for r in df.select("k", C.part_starts(F.col("items"), F.lit(100)).alias("s")).collect()}
    for k, items in rows:
        assert got[k] == _starts([x["size"] for x in items], [x["blank"] for x in items], [x["cut"] for x in items], 100), items
    sizes = spark.createDataFrame([([60, 30, 30, 90, 5, 5, 200, 1],)], "v array<bigint>")
    assert sizes.select(C.packed_starts(F.col("v"), F.lit(100), F.lit(125)).alias("s")).first().s == [0, 3, 6, 7]


def _chunks(spark, path, text):
    found = C.file_chunks(spark.createDataFrame([(path, text)], "path string, text string")).orderBy("line_start").collect()
    return [(c.kind, c.name, c.line_start, c.line_end) for c in found]


def test_chunks_of_texts_and_scripts(spark):
    assert _chunks(spark, "x.md", "intro\n# A\ntext\n## B\n```\n# no heading\n```\n# C\nend\n") == [("md_section", "", 1, 1), ("md_section", "A", 2, 3), ("md_section", "A > B", 4, 7), ("md_section", "C", 8, 9)]
    long = "".join(f"  x{i} <- {i}\n" for i in range(120))
    assert _chunks(spark, "x.R", f"# about f\nf <- function(a) {{\n{long}}}\n\n# about g\ng <- function(b) b\n") == [("r_code", "f", 1, 123), ("r_code", "g", 125, 126)]
    with pytest.raises(Exception, match="no chunker"):
        _chunks(spark, "x.bin", "a")


def test_chunks_of_sources(spark):
    text = "*** | licence\nparameter k_a(t) \"a\";\n\n* about e\n* more\ne_a(t)..\n a =e= b;\n\nk_a(t) = 1;\n$ifthen %x% == 1\nk_a(t) = 2;\n* end\n$endif\n"
    found = C.file_chunks(spark.createDataFrame([("modules/07_trade/simple/equations.gms", text)], "path string, text string")).orderBy("line_start").collect()
    assert [(c.kind, c.name, c.line_start, c.line_end, c.conditions) for c in found] == [
        ("declaration", "k_a", 2, 2, []), ("equation", "e_a", 4, 7, []), ("gams_block", "", 9, 10, []), ("gams_block", "", 11, 12, ["%x% == 1"]), ("gams_block", "", 13, 13, []),
    ]
    assert {(c.module, c.realization, c.phase) for c in found} == {("07_trade", "simple", "equations")}
    assert _chunks(spark, "modules/07_trade/module.gms", "* a\n\n* b\n") == [("module_doc", "07_trade", 1, 3)]
    main = "* intro\nk_a = 1; !! def = 1 !! regexp = 1|2\n*' (1): one\n\n*' (2): two\n* k_other\n*' c_b: about b\nc_b = 2; !! def = 2\n$setglobal mode fast !! note\nrest = 1;\n"
    assert _chunks(spark, "main.gms", main) == [("switch", "k_a", 1, 6), ("switch", "c_b", 7, 8), ("switch", "mode", 9, 9), ("gams_block", "", 10, 10)]
    state = S.line_state(spark.createDataFrame([("main.gms", main)], "path string, text string"))
    assert sorted((r.line, r.name, r.value, r.allowed) for r in S.switches(state).collect()) == [(2, "k_a", "1", "1|2"), (8, "c_b", "2", ""), (9, "mode", "fast", "")]


def test_where_used(state, spark):
    s = state("scalar k_a \"k_b here\" / %k_s% /;\nk_b(t) = k_a + k_b(t-1);\ne_a(t)$(k_s eq 1).. k_b(t) =e= k_a;\nif(k_s eq 1,\n k_a = 2;\n);\n* k_a\nparameter k_b(t), e_a;\n")
    switches = spark.createDataFrame([("k_s",)], "name string")
    used = U.where_used(s, U.declared_symbols(s), switches).collect()
    assert sorted((r.line, r.name, r.role) for r in used) == [
        (1, "k_a", "assigned"), (1, "k_s", "read"), (2, "k_a", "read"), (2, "k_b", "assigned"), (3, "e_a", "equation"), (3, "k_a", "equation"), (3, "k_b", "equation"), (3, "k_s", "equation"),
        (4, "k_s", "read"), (5, "k_a", "assigned"), (8, "e_a", "declared"), (8, "k_b", "declared"),
    ]
    assert {(r.line, tuple(r.guards)) for r in used if r.guards} == {(5, ("k_s eq 1",))} and {r.context for r in used if r.line == 3} == {"e_a"}


def test_heads_and_left_sides_of_any_depth(spark):
    deep = lambda n, inner: "(" * n + inner + ")" * n
    text = "\n".join([f"q_deep{deep(9, 't')}$({deep(12, 'a')}) .. x =e= 1;", f"v_deep.fx{deep(11, 'i')}$(b[c(d)]) = {deep(8, '1')};", "q_flat(t) .. x =e= (1;"])
    state = S.line_state(spark.createDataFrame([("modules/01_a/b/x.gms", text)], "path string, text string"))
    assert [r.equation for r in S.equations(state).orderBy("s").collect()] == ["q_deep", "q_flat"]
    assert state.filter("n = 2").first().assigned == ["v_deep"]


def test_parts_of_an_entry(spark):
    rows = {
        " p_a(t,all(r)) 'a (b) c' / 1 /": ("p_a", "t,all(r)", "a (b) c"), "p_b": ("p_b", "", ""), 'p_c "it\'s"; x': ("p_c", "", "it's"), "p_d unquoted text / 2": ("p_d", "", "unquoted text"),
        "p_e(((x)),y) z": ("p_e", "((x)),y", "z"), "p_f (t)  'x": ("p_f", "t", ""), "9x y": ("", "", "9x y"), "": ("", "", ""),
    }
    df = spark.createDataFrame([(k,) for k in rows], "piece string").select("piece", S.entry_parts(F.col("piece")).alias("e"))
    assert {r.piece: tuple(r.e) for r in df.collect()} == rows


def test_what_comments_and_functions_name(spark):
    from traceframe.operators import chunks as C

    rows = {
        "*' cm_flag: text": "cm_flag", "** c_x": "c_x", "*c12_Abc more": "c12_abc", "* cm_": "", "* cmx_a": "", "*' c1_a": "", "cm_a = 1;": "", "* see cm_a": "", "*'  c_a-b": "c_a", "": "",
    }
    df = spark.createDataFrame([(k,) for k in rows], "line string")
    assert {r.line: r.s for r in df.select("line", C.described_switch(F.col("line")).alias("s")).collect()} == rows
    named = {"f <- function(x) 1": "f", "  a.b =function (y)": "a.b", "f <- functional(x)": "", "x[1] <- function(y)": "", "plain": "", "<- function(x)": "", "y = 3": ""}
    df = spark.createDataFrame([(k,) for k in named], "line string")
    assert {r.line: r.s for r in df.select("line", C.r_function(F.col("line")).alias("s")).collect()} == named
    lines = {"*** | (C) x": True, "*** SOF file": True, "*** SOFT": False, "*** text": False}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.s for r in df.select("line", C.is_license(F.col("line")).alias("s")).collect()} == lines
