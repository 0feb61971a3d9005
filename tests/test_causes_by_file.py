"""All causes of a file in one pass, and files of any length together."""

import random

import pytest

from tests.test_alignment import SCHEMA, cascade
from traceframe.operators import alignment as A


@pytest.mark.parametrize("most", [10_000, 60, 0])
def test_files_of_any_length_have_the_same_causes(spark, monkeypatch, most):
    rng = random.Random(5)
    side = lambda n, files: [(rng.choice(files), rng.choice("ab"), rng.randint(0, 90), i) for i in range(n)]
    ref, idx = side(200, ["f", "f", "f", "g", "h"]), side(180, ["f", "f", "g", "i"])
    monkeypatch.setattr(A, "FILE_ROWS", most)
    found = A.causes(spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(idx, SCHEMA), "file", "role", "place", "entry", tolerance=2, far=9).collect()
    assert len(found) == len(ref) + len(idx)
    assert {(r.side, r.entry): (r.cause, r.partner) for r in found} == cascade(ref, idx, 2, 9)


def test_short_files_are_dealt_out_once(spark, monkeypatch):
    monkeypatch.setattr(A, "align", None)  # not needed, as no file is long
    rows = spark.createDataFrame([("f", "a", i, i) for i in range(50)] + [(None, None, 3, 99)], SCHEMA)
    found = A.causes(rows, rows, "file", "role", "place", "entry", tolerance=1, far=2)
    assert {(r.side, r.entry, r.cause, r.partner) for r in found.collect()} == {(s, e, "same", e) for s in (0, 1) for e in [*range(50), 99]}
