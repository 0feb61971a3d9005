"""Diffs and agreement of whole tables: multisets, nulls, and tasks of a bounded size."""

import re
from collections import Counter

from traceframe.operators import quality as Q


def test_differences_are_multisets_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(Q, "COPIES", 3)
    old = [(1, None)] * 8 + [(2, 0.0)] * 2 + [(3, float("nan"))] + [(None, 1.0)] * 2
    new = [(1, None)] + [(2, -0.0)] * 9 + [(3, float("nan"))] + [(4, 1.0)]
    found = Q.table_diff(*(spark.createDataFrame(r, "k int, v double") for r in (old, new)))
    assert Counter(map(tuple, found.collect())) == {(1, None, "gone"): 7, (2, 0.0, "new"): 7, (None, 1.0, "gone"): 2, (4, 1.0, "new"): 1}


def test_null_keys_agree_with_each_other(spark):
    rows = lambda r: spark.createDataFrame(r, "k int, g string")
    found = Q.agreement(rows([(1, "a"), (None, "a"), (1, "a"), (2, "b")]), rows([(None, "a"), (1, "a"), (3, "b")]), ["k"], ["g"])
    assert {tuple(r) for r in found.collect()} == {("a", 2, 2, 2, 1.0, 1.0), ("b", 1, 1, 0, 0.0, 0.0), (None, 3, 3, 2, 0.666667, 0.666667)}


def test_tasks_grow_with_the_table_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(Q, "parts", lambda amount: -(-amount // 50), raising=False)
    old, new = spark.range(1_000), spark.range(500, 1_500)
    for found in (Q.table_diff(old, new), Q.agreement(old, new, ["id"], [])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"hashpartitioning\(id#\d+L?(?:, _salt#\d+)?, (\d+)\)", plan)) == {"40"} and "Join" not in plan
