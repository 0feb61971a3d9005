"""Whitening against numpy on exact whole numbers."""

import math

import numpy as np
import pytest

from traceframe.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, n string, pair int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "n", 9) for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """{row: [(component, deviation, whitened)]}, n and explained, in Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for _, v in kept]
    distinct = sorted(set(xs))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    m = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for (i, _), x in zip(kept, xs):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        z = (np.array(x) - np.array(sums) / n) @ vectors[:, :components] / np.sqrt(values[:components])
        out += [(i, k + 1, deviation, z[k]) for k in range(min(components, len(x)))]
    return out, n, values / values.sum()


def same(found, rows, components=4):
    wanted, n, shares = brute(rows, components)
    assert len(found) == len(wanted)
    key = lambda r: (r[0] if r[0] is not None else -1, r[1], r[2], abs(r[3]))
    got = sorted(((r.vec_id, r.component, r.deviation, r.whitened) for r in found), key=key)
    wanted = sorted(wanted, key=key)
    sign = {}
    for (i, k, dev, z), (j, c, want, y) in zip(got, wanted):
        assert (i, k, dev) == (j, c, want)
        if abs(y) > 1e-6:
            assert sign.setdefault(k, np.sign(z * y)) == np.sign(z * y)
        assert abs(z) == pytest.approx(abs(y), abs=1e-8)
    for r in found:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)


def test_equals_numpy_with_copies_nulls_and_odd_width(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, [2, 1, 0.7, 0.4, 0.3, 0.2, 0.1, 0.6, 0.5, 1.4, 0.15])]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(7, rows[7][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, [None] + [1.0] * 10), (2002, [float("nan")] + [1.0] * 10), (2003, [float("-inf")] + [1.0] * 10)]
    same(W.whiten(table(spark, rows)).collect(), rows)


@pytest.mark.parametrize("width", [1, 3, 8, 17])
def test_other_widths(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, [float(c) for c in rng.normal(0, 1 + np.arange(width))]) for i in range(60)]
    same(W.whiten(table(spark, rows)).collect(), rows)


def test_whole_table(spark):
    from pyspark.sql import functions as F

    source = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in source.collect()]
    found = W.op13_whitening(spark, "/root/testdata/sf0.01")
    assert [f.name for f in found.schema][:6] == ["vec_id", "component", "n", "deviation", "whitened", "explained"]
    assert found.filter(F.col("whitened").isNull()).count() == 0
    same(found.collect(), rows)


def test_defined_results_at_the_edges(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, None), (2, [])])).collect() == []
    alike = W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()  # no variance
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened) for r in alike) == [(1, 1, 1, 0, None), (1, 2, 1, 0, None), (2, 1, 1, 0, None), (2, 2, 1, 0, None)]
    flat = W.whiten(table(spark, [(1, [1.0, 0.0]), (2, [3.0, 0.0])])).collect()  # one of two components has none
    assert [(r.component, r.whitened is None) for r in sorted(flat)] == [(1, False), (2, True)] * 2
    shorter = W.whiten(table(spark, [(1, [1.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0]), (4, [2.0, 2.0])])).collect()
    assert {r.vec_id for r in shorter} == {1, 2, 4}


def test_deviation_beyond_a_long_is_exact_or_null(spark):
    rows = [(i, [float(2 ** (20 + i)), 1.0]) for i in range(12)]
    for r in W.whiten(table(spark, rows)).collect():
        n, xs = 12, [2 ** (28 + i) for i in range(12)]
        want = (n * xs[r.vec_id] - sum(xs)) ** 2
        assert r.deviation == (want if want < 1 << 63 else None)


def test_covariance_is_exact_for_whole_numbers(spark):
    x = np.array([[1, 5, 2], [3, 1, 4], [5, 3, 0]])
    got = W.covariance(spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>"), [3.0, 3.0, 2.0], 3, block=2)
    assert np.allclose(got, np.cov(x.T, bias=True), atol=1e-15)
