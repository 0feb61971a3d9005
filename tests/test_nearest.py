"""Nearest vectors: what SQL gives for vectors of zeros, which have no angle, and for scores that are halves of the last digit."""

import hashlib

import duckdb
import pytest

from tests.compare import compare, connect
from traceframe import catalog
from traceframe.operators import search as R

SF = "/root/testdata/sf0.01"
NEAR = """SELECT q.id AS query, v.id, round(list_cosine_similarity(v.x, q.x), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(v.x, q.x), 6) DESC, v.id) AS rank
  FROM v JOIN v q ON v.id <> q.id WHERE q.id % 3 = 0 QUALIFY rank <= {}"""


def near_as_sql(spark, rows, k):
    con = duckdb.connect()
    con.execute("CREATE TABLE v (id BIGINT, x DOUBLE[])")
    con.executemany("INSERT INTO v VALUES (?, ?)", rows)
    con.execute("SET threads=1")
    vectors = spark.createDataFrame(rows, "id bigint, x array<double>")
    found = R.nearest(vectors, vectors.filter("id % 3 = 0"), "id", "x", k).select("query", "id", "score", "rank").collect()
    text = lambda rows: sorted((q, n, i, str(s + 0.0)) for q, i, s, n in rows)  # noqa: E731  (NaN equals nothing)
    return text(found), text(con.execute(NEAR.format(k)).fetchall())


@pytest.mark.parametrize("k", [1, 3, 20])
def test_vectors_of_zeros_come_first(spark, k):
    rows = [(i, [float(i % 4), float(i % 5), float(-i % 3)]) for i in range(30)] + [(i, [0.0, 0.0, 0.0]) for i in (30, 31, 33)]
    found, wanted = near_as_sql(spark, rows, k)
    assert found == wanted and any(s == "nan" for *_, s in found)


def test_halves_are_rounded_as_in_sql(spark):
    halves = [[113.0, 60.0, 3.0, 2.0, 1.0, 1.0], [-113.0, 60.0, 3.0, 2.0, 1.0, 1.0], [115.0, 56.0, 3.0, 3.0, 2.0, 1.0]]  # of length 128
    found, wanted = near_as_sql(spark, [(0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), *[(i + 1, x) for i, x in enumerate(halves)]], 5)
    assert found == wanted and {s for q, *_, s in found if q == 0} == {"0.882813", "-0.882813", "0.898438"}


def cancelling():
    """Two tokens that ``hashed_vectors`` counts in one place with opposite signs."""
    held = {}
    for i in range(400):
        h = hashlib.md5(f"odd{i}".encode()).hexdigest()
        place, sign = int(h[:2], 16) % 64, int(h[2], 16) >= 8
        if (place, not sign) in held:
            return held[place, not sign], f"odd{i}"
        held[place, sign] = f"odd{i}"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents, some of which have tokens that cancel each other, and benchmark items."""
    out = str(tmp_path_factory.mktemp("odd"))
    docs, text = spark.read.parquet(f"{SF}/documents.parquet"), " ".join(cancelling())
    more = spark.createDataFrame([(2_000 + i, text, "en", "src1", len(text)) for i in range(3)], docs.schema)
    docs.unionByName(more).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.mark.parametrize("name", ["e01_recall_by_mode", "e02_hybrid_misses"])
def test_search_with_tokens_that_cancel(spark, odd, name):
    assert compare(spark, odd, catalog.queries()[name], catalog.oracles()[name], connect(odd)) == ""
