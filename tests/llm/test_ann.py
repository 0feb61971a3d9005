"""The inverted multi-index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from traceframe.llm import ann


def _frame(spark, x, first=0):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist(), first)], "vec_id long, embedding array<double>")


def _found(rows):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def _recall(x, found, k):
    """Mean share of the k nearest that were found; checks ranks, scores and order on the way."""
    shares = []
    for q, rows in found.items():
        assert [r for r, _, _ in rows] == list(range(1, k + 1)) and q not in {v for _, v, _ in rows}
        assert np.allclose([s for _, _, s in rows], x[[v for _, v, _ in rows]] @ x[q], rtol=1e-12)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        score = x @ x[q]
        score[q] = -np.inf
        shares.append(len({v for _, v, _ in rows} & set(np.argsort(-score, kind="stable")[:k].tolist())) / k)
    return float(np.mean(shares))


def test_recall_on_many_vectors(spark):
    rng = np.random.default_rng(5)
    loose = rng.normal(size=(24_000, 32))
    centers = rng.normal(size=(300, 32)) * 3
    tight = centers[rng.integers(0, 300, 24_000)] + rng.normal(size=(24_000, 32))
    for x, most in ((loose, 1.0), (tight, 0.35)):
        df = _frame(spark, x)
        found = _found(ann.search(df, df.filter("vec_id % 50 = 0"), k=20).collect())
        assert len(found) == len(x) // 50 and _recall(x, found, 20) >= 0.9
        centers_of_halves = [ann._kmeans(x[:20_000, :16], 19, rng), ann._kmeans(x[:20_000, 16:], 19, rng)]
        assert ann.wanted_share(x[:20_000], centers_of_halves, 20, len(x)) <= most  # clustered vectors need much less than half


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(-4, 5, (600, 8)).astype(float)
    x[(x == 0).all(1)] = 1.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600 + i, x[0].tolist()) for i in range(60)]
    bad = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [float("inf")] * 8), (0, [9.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("block", F.lit(2))
    held = np.array([v for _, v in rows])
    assert tuple(held[0]) < (9.0,) * 8  # of two vectors with id 0 the smaller counts
    found = _found(ann.search(df, df.filter("vec_id % 20 = 0"), k=20).collect())
    assert sorted(found) == [i for i, _ in rows if i % 20 == 0]
    tied = 0
    for q, got in found.items():
        score = held @ held[q]
        assert [s for _, _, s in got] == score[[v for _, v, _ in got]].tolist() and [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        score[q] = -np.inf
        tied += np.isin([s for _, _, s in got], np.sort(score)[::-1][:20]).mean()
    assert tied / len(found) >= 0.9
    short = spark.createDataFrame([(7, [1.0] * 7)], "vec_id long, embedding array<double>")
    assert ann.search(df, short).count() == 0  # the length is that of the vectors searched
    assert ann.search(df.filter("false"), df.filter("false")).count() == 0 and ann.search(df, df.filter("false")).count() == 0


def test_few_candidates_are_all_returned(spark):
    x = np.random.default_rng(1).normal(size=(9, 4))
    found = _found(ann.search(_frame(spark, x), _frame(spark, x), k=20).collect())
    assert {q: {v for _, v, _ in r} for q, r in found.items()} == {q: set(range(9)) - {q} for q in range(9)}
    assert _recall(x, found, 8) == 1.0


def test_a_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full((900, 6), 2.0) + rng.normal(size=(900, 6)) * 1e-3, rng.normal(size=(100, 6))])
    df = _frame(spark, x)
    assert _recall(x, _found(ann.search(df, df.filter("vec_id % 50 = 0"), k=10).collect()), 10) >= 0.9


def test_walk_and_regions():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7), rng.normal(size=5)
    walked = list(ann.walk(a, b))
    assert sorted(walked) == [(i, j) for i in range(7) for j in range(5)] and [a[i] + b[j] for i, j in walked] == sorted(a[i] + b[j] for i, j in walked)
    sizes = rng.integers(0, 40, 30)
    place, blocks = ann.regions(rng.normal(size=(30, 3)), sizes, 50)
    held = np.bincount(place, sizes)
    assert len(blocks) == len(held) and (held <= 50).all() and (ann.regions(np.zeros((1, 3)), np.array([120]), 50)[1] == [3]).all()
