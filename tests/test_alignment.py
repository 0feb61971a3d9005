"""Alignment against two plain pointers, and as many matches as there can be."""

import random
from collections import Counter

import pytest

from traceframe.operators import alignment as A

SCHEMA = "file string, role string, place int, entry bigint"


def pointers(left, right, tolerance):
    """Pairs of two sorted lists of (place, ..., entry), by two pointers."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        a, b = left[i], right[j]
        if abs(a[0] - b[0]) <= tolerance:
            out.append((a[-1], b[-1]))
            i, j = i + 1, j + 1
        elif a[0] < b[0]:
            i += 1
        else:
            j += 1
    return out


def cascade(ref, idx, tolerance, far):
    cause, left = {}, [list(ref), list(idx)]
    steps = [("same", True, 0), ("near", True, tolerance), ("other role", False, tolerance), ("moved", True, far)]
    files = [{r[0] for r in side} for side in left]
    for name, with_role, within in steps:
        groups = {(r[0], r[1] if with_role else None) for r in left[0]}
        for g in groups:
            own = [sorted((r[2], r[1], r[3]) for r in side if (r[0], r[1] if with_role else None) == g) for side in left]
            for a, b in pointers(*own, within):
                cause[0, a], cause[1, b] = (name, b), (name, a)
        left = [[r for r in side if (i, r[3]) not in cause] for i, side in enumerate(left)]
    for i, side in enumerate(left):
        for r in side:
            cause[i, r[3]] = ("unknown file" if r[0] not in files[1 - i] else ("missing", "extra")[i], None)
    return cause


@pytest.mark.parametrize("seed", range(3))
def test_every_entry_has_one_cause(spark, seed):
    rng = random.Random(seed)
    side = lambda n, files: [(rng.choice(files), rng.choice("ab"), rng.randint(0, 150), i) for i in range(n)]
    ref, idx = side(300, ["f", "g", "h", "f"]), side(280, ["f", "g", "i"])
    found = A.causes(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(idx, SCHEMA), "file", "role", "place", "entry", tolerance=2, far=9).collect()
    assert len(found) == len(ref) + len(idx)
    assert {(r.side, r.entry): (r.cause, r.partner) for r in found} == cascade(ref, idx, 2, 9)


def test_a_long_group_is_dealt_out_and_one_dense_stretch_is_right(spark):
    ref = [("f", "a", 100 * i, i) for i in range(2_000)] + [("g", "a", i // 3, 5_000 + i) for i in range(3_000)]
    idx = [("f", "a", 100 * i + i % 5, i) for i in range(2_000)] + [("g", "a", i // 2, 5_000 + i) for i in range(2_000)]
    rows = [(*r, 0) for r in ref] + [(*r, 1) for r in idx]
    table = spark.createDataFrame(rows, SCHEMA + ", side int")
    got = {(r.side, r.entry): r.partner for r in A.align(table, ["file", "role"], "place", "side", "entry", 3).collect()}
    assert len(got) == len(rows)
    want = [p for f in "fg" for p in pointers(*[sorted((r[2], r[3]) for r in s if r[0] == f) for s in (ref, idx)], 3)]
    assert {e: p for (s, e), p in got.items() if s == 0 and p is not None} == dict(want)
    assert Counter(p for p in got.values() if p is not None).most_common(1)[0][1] <= 2


def test_empty_sides(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("f", "a", 3, 1)], SCHEMA)
    run = lambda a, b: [(r.side, r.cause) for r in A.causes(a, b, "file", "role", "place", "entry", tolerance=1, far=2).collect()]
    assert run(empty, empty) == [] and run(one, empty) == [(0, "unknown file")] and run(empty, one) == [(1, "unknown file")]


def test_anchors_say_what_they_found(spark):
    from traceframe.operators.anchors import Anchor, check

    tables = {"t": spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string"), "empty": spark.createDataFrame([], "n int")}
    asked = [Anchor("any", "t", "n > 1"), Anchor("null is no match", "t", "s <> 'a'", 1, 1), Anchor("too many", "t", "true", 0, 2), Anchor("nothing", "empty", "true", 0, 0), Anchor("lacking", "empty", "true")]
    found = {r.rule: (r.table, r.found, r.fine) for r in check(spark, tables.__getitem__, asked).collect()}
    assert found == {"any": ("t", 2, True), "null is no match": ("t", 1, True), "too many": ("t", 3, False), "nothing": ("empty", 0, True), "lacking": ("empty", 0, False)}
    assert check(spark, tables.__getitem__, []).count() == 0
