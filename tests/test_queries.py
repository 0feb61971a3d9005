"""Every query with SQL gives the SQL's rows; those without have their rows asserted here."""

import pytest

from tests.compare import compare, connect
from traceframe import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query, sql = catalog.queries()[name], catalog.oracles().get(name)
    if sql:
        assert compare(spark, SF, query, sql, con) == ""
    else:
        columns = sorted(query(spark, SF).columns)
        got = {tuple(_plain(r[c]) for c in columns) for r in query(spark, SF).collect()}
        assert got == {tuple(row[c] for c in columns) for row in ROWS[name]} if name in ROWS else name in CHECKED and CHECKED[name](query(spark, SF))


def _plain(value):
    return tuple(value) if isinstance(value, list) else value


def _row(names, *values):
    return dict(zip(names.split(), values, strict=True))


_STORED = '"%cm_y%" == "on"'
ROWS = {
    "l20_aborts": [_row("path line kind conditions message", "core/a.gms", 2, "compile", ("%x% == 'a'",), "bad x"), _row("path line kind conditions message", "core/a.gms", 5, "run", ("cm_y eq 1",), "no y")],
    "t03_flags": [_row("path line name value conditions", "core/a.gms", 2, "cm_flag", "YES", ('"%s%" == "b"',))],
}
#: Queries with many rows: what holds for them.
CHECKED = {
    "l09_line_conditions": lambda df: {(r.path.split("/")[-1], r.n): (r.conditions, r.guards) for r in df.collect() if r.conditions or r.guards}
    == {("equations.gms", 2): ([_STORED], []), ("equations.gms", 3): ([_STORED], []), ("presolve.gms", 7): ([], ["cm_x eq 1"])},
    "c06_file_chunks": lambda df: {(r.path.split("/")[-1], r.kind, r.name, r.line_start, r.line_end) for r in df.collect()}
    == {
        ("presolve.gms", "gams_block", "", 1, 8), ("declarations.gms", "declaration", "p_a, p_m", 1, 4), ("declarations.gms", "declaration", "p_z", 5, 5), ("declarations.gms", "declaration", "q_x", 6, 6),
        ("equations.gms", "gams_block", "", 1, 1), ("equations.gms", "equation", "q_x", 2, 3), ("equations.gms", "gams_block", "", 4, 4), ("main.gms", "switch", "cm_x", 1, 1), ("main.gms", "switch", "cm_y", 2, 2),
        ("plot.R", "r_code", "f", 1, 4), ("README.md", "md_section", "", 1, 1), ("README.md", "md_section", "Use", 2, 3), ("README.md", "md_section", "Use > More", 4, 5),
    },
}
