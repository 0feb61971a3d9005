"""What search shuffles: texts and blocks, and not a row for each token."""

import random
import re

from pyspark.sql import functions as F

from traceframe.operators import search as R
from traceframe.operators import text_index as T

COLUMNS = {"title": 3.0, "body": 1.0}


def docs(spark, n, seed, first=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(first + i, rng.choice([None, "w1 w2"]), " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([0, 3, 50])))) for i in range(n)], "id bigint, title string, body string")


def dealt_above(df, node):
    """By what rows are shuffled above (after) the first step of a kind."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"(?:hash|range)partitioning\((.*?), \d+\)", plan[: plan.index(node)])]


def test_tokens_are_counted_where_the_text_is(spark, tmp_path):
    posted = R.postings(docs(spark, 50, 1), "id", COLUMNS)
    assert dealt_above(posted, "Generate") == []


def test_many_queries_are_scored_band_by_band(spark, tmp_path, monkeypatch):
    table = docs(spark, 300, 2).cache()
    monkeypatch.setattr(T, "BAND", 16)
    index = T.remove(T.create(table, str(tmp_path / "i"), "id", COLUMNS), table.filter("id % 7 = 0"))
    asked = spark.createDataFrame([(q, f"w{w}") for q in range(40) for w in range(q, q + 9)], "q int, term string")
    want = sorted(map(tuple, T.top(spark, index, asked, "q", 5)[0].collect()))
    monkeypatch.setattr(T, "MAX_TERMS", 3)
    monkeypatch.setattr(T, "parts", lambda amount, each=0: 3, raising=False)
    found, report = T.top(spark, index, asked, "q", 5)
    assert dealt_above(found, "Generate") == ["q"]
    assert sorted(map(tuple, found.collect())) == want and want
    assert all(r.blocks == r.read for r in report.collect())


def test_hashed_vectors_shuffle_no_tokens(spark):
    vectors = R.hashed_vectors(docs(spark, 50, 3), "id", "body")
    assert not [x for x in dealt_above(vectors, "Generate") if "token" in x]
