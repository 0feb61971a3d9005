"""The stored index against scoring every posting, and its parts against a fresh build."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from traceframe.operators import search as R
from traceframe.operators import text_index as T
from traceframe.sources import pointers

COLUMNS = {"title": 3.0, "body": 1.0}
WORDS = [f"w{i}" for i in range(60)]


def rows(n, seed, first=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    out = [(first + i, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 3))), " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 3, 8, 40, 200])))) for i in range(n)]
    return [(i, t or None, b) for i, t, b in out]


@pytest.fixture(scope="module")
def table(spark):
    return lambda r: spark.createDataFrame(r, "id bigint, title string, body string")


def plain(docs, terms, k):
    posted = R.postings(docs, "id", COLUMNS)
    stats = R.index_stats(posted, "id").first()
    scored = R.bm25(posted, docs.count(), stats.average, terms, "id", ["q"])
    return sorted(map(tuple, R.top(scored, ["q"], "id", k).select("q", "id", "score", "rank").collect()))


def asked(spark, queries):
    return spark.createDataFrame([(q, w) for q, text in queries.items() for w in text.split()], "q int, term string")


QUERIES = {1: "w0 w1", 2: "w58", 3: "w3 w3 w40 w41", 4: "nowhere", 5: " ".join(WORDS), 6: "w59 w0"}


def test_best_rows_equal_scoring_everything(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BAND", 16)
    docs = table(rows(900, 1)).cache()
    index = T.create(docs, str(tmp_path / "i"), "id", COLUMNS)
    for k in (1, 7):
        found, report = T.top(spark, index, asked(spark, QUERIES), "q", k)
        assert sorted(map(tuple, found.select("q", "id", "score", "rank").collect())) == plain(docs, asked(spark, QUERIES), k)
        told = {r.q: (r.blocks, r.read) for r in report.collect()}
        assert all(read <= blocks for blocks, read in told.values()) and told[3][1] < told[3][0]
    many, _ = T.top(spark, index, asked(spark, QUERIES), "q", 2_000)
    assert sorted(map(tuple, many.select("q", "id", "score", "rank").collect())) == plain(docs, asked(spark, QUERIES), 2_000)


def same(spark, index, fresh):
    order = ["term", "id", "tf", "length"]
    a, b = (sorted(map(tuple, T.live_postings(spark, x).select(*order).collect())) for x in (index, fresh))
    assert a == b and (index.rows, round(index.average, 9)) == (fresh.rows, round(fresh.average, 9))
    assert sorted(map(tuple, T.frequencies(spark, index).collect())) == sorted(map(tuple, T.frequencies(spark, fresh).collect()))
    best = [sorted(map(tuple, T.top(spark, x, asked(spark, QUERIES), "q", 5)[0].select("q", "id", "score", "rank").collect())) for x in (index, fresh)]
    assert best[0] == best[1]


def test_adding_deleting_and_merging_equal_a_fresh_build(spark, table, tmp_path):
    old, more, changed = rows(200, 2), rows(80, 3, 1_000), rows(40, 4, 50)  # 50 to 89 get other texts
    index = T.create(table(old), str(tmp_path / "i"), "id", COLUMNS)
    index = T.add(index, table(more))
    index = T.update(index, table(old[50:90]), table(changed))
    index = T.remove(index, table(more[:30]))
    index = T.update(index, table(changed[:5]), table(rows(5, 5, 50)))
    now = old[:50] + rows(5, 5, 50) + changed[5:] + old[90:] + more[30:]
    fresh = T.create(table(now), str(tmp_path / "f"), "id", COLUMNS)
    assert len(index.segments) == 7
    same(spark, index, fresh)
    merged = T.merge(spark, index)
    assert len(merged.segments) == 1 and T.open_index(spark, str(tmp_path / "i")) == merged
    same(spark, merged, fresh)
    with pytest.raises(FileExistsError):  # worked on an older generation
        T.add(index, table(more))


def test_empty_indexes_and_rows_without_tokens(spark, table, tmp_path):
    index = T.create(table([]), str(tmp_path / "i"), "id", COLUMNS)
    assert T.top(spark, index, asked(spark, QUERIES), "q", 3)[0].count() == 0
    index = T.add(index, table([(1, None, None), (2, "", "?"), (3, "a", None)]))
    assert (index.rows, index.average) == (3, 1.0)
    found, _ = T.top(spark, index, asked(spark, {1: "a b"}), "q", 3)
    assert [r.id for r in found.collect()] == [3]
    with pytest.raises(FileNotFoundError):
        T.open_index(spark, str(tmp_path / "none"))


def test_more_terms_than_a_plan_lists(spark, table, tmp_path, monkeypatch):
    docs = table(rows(120, 7))
    index = T.create(docs, str(tmp_path / "i"), "id", COLUMNS)
    want = plain(docs, asked(spark, QUERIES), 4)
    monkeypatch.setattr(T, "MAX_TERMS", 3)
    assert sorted(map(tuple, T.top(spark, index, asked(spark, QUERIES), "q", 4)[0].select("q", "id", "score", "rank").collect())) == want


def test_pointers_are_read_while_they_are_published(spark, tmp_path):
    root, seen, stop = str(tmp_path / "p"), [], threading.Event()
    assert pointers.latest(spark, root) is None
    pointers.advance(spark, root, "state 1")

    def read():
        while not stop.is_set():
            seen.append(pointers.latest(spark, root))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(2, 41):
        assert pointers.advance(spark, root, f"state {i}") == i
    stop.set()
    reader.join()
    assert seen and all(text == f"state {number}" for number, text in seen)
    assert [n for n, _ in seen] == sorted(n for n, _ in seen)
    assert len(pointers.generations(spark, root)) <= pointers.KEPT + 1


def test_pointers_after_a_crash(spark, tmp_path):
    root = tmp_path / "p"
    pointers.advance(spark, str(root), "one\ntwo lines")
    (root / "generation-000000000002").write_text("cut off in the mid")  # a store without rename, and a writer that died
    (root / ".draft-x").write_text("never renamed")
    assert pointers.latest(spark, str(root)) == (1, "one\ntwo lines")
    assert pointers.advance(spark, str(root), "next") == 3 and pointers.latest(spark, str(root)) == (3, "next")
    with pytest.raises(FileExistsError):
        pointers.advance(spark, str(root), "late", after=1)
    assert not [p for p in root.iterdir() if p.name.startswith(".draft") and not p.name.endswith("-x")]


def test_publishers_that_race_lose_nothing(spark, tmp_path):
    root, took = str(tmp_path / "p"), []
    pointers.advance(spark, root, "before")
    threads = [threading.Thread(target=lambda i=i: took.append(pointers.advance(spark, root, f"by {i}"))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(took) == [2, 3, 4, 5] and pointers.latest(spark, root)[0] == 5


def test_pointers_by_rename(spark, tmp_path, monkeypatch):
    real = pointers._on_disk
    place, store, path = pointers._store(spark, str(tmp_path / "p"))
    monkeypatch.setattr(pointers, "_on_disk", lambda at, text: pointers._by_rename(spark, at, store, path, text))
    assert [pointers.advance(spark, str(tmp_path / "p"), f"state {i}") for i in range(3)] == [1, 2, 3]
    assert pointers.latest(spark, str(tmp_path / "p")) == (3, "state 2")
    monkeypatch.setattr(pointers, "_on_disk", real)
    assert pointers.advance(spark, str(tmp_path / "p"), "linked") == 4 and pointers.latest(spark, str(tmp_path / "p")) == (4, "linked")


def test_postings_are_pruned_by_the_limit_in_each_task(spark, table, tmp_path):
    index = T.create(table(rows(60, 8)), str(tmp_path / "i"), "id", COLUMNS)
    found, _ = T.top(spark, index, asked(spark, {1: "w0"}), "q", 3)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert found.select(F.max("rank")).first()[0] == 3
