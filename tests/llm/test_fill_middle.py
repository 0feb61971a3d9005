"""Fill-in-the-middle against a plain Python version."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceframe.llm import fill_middle as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text, seed=1):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc, n, form, a, b - a, sha(out), sha(text))


def digests(found, id_col="doc_id"):
    rows = found.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(M.restored(F.col("output"), F.col("form")), 256)).collect()
    return sorted(map(tuple, rows), key=repr)


ODD = ["", "a", "é", "日本", "🎉🎉 b", "x<P>y", "<S>", "a<M", "<", "<P", "S>", "ends <", "> begins", "a\n\nb", "é" * 700, "日" * 300 + "a" * 300, "́", "\x00", "aé" * 512]


def test_equals_brute_force_with_copies_nulls_and_repeats(spark, docs):
    rows = [(i, ODD[i % len(ODD)]) for i in range(300)] + [(500, None), (None, "abc def"), (None, None), (3, ODD[3]), (3, ODD[3])]
    rows += [(1000 + i, "the same text é") for i in range(700)]
    found = M.fill_in_middle(docs(rows, key="k", slice=3, ids="x", part=1, n=5, output="o"))
    assert digests(found) == sorted((brute(*r) for r in rows), key=repr)
    assert M.fill_in_middle(docs([])).collect() == []


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    found = M.op12_fill_middle(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert {r.form for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_texts_that_share_a_key_stay_apart_and_hot_ones_are_sliced(spark, docs):
    rows = [(i, f"text {i % 7}") for i in range(600)] + [(1000 + i, "hot") for i in range(900)]
    table = docs(rows).repartition(16)
    index = M.index_texts(table, key=F.length("text").cast("bigint"), copies=100)
    held = [(r.text.decode(), sorted(map(int, r.ids))) for r in index.select(F.col("text").cast("binary"), "ids").collect()]
    assert sorted(i for _, ids in held for i in ids) == sorted(i for i, _ in rows)
    assert all(dict(rows)[i] == text for text, ids in held for i in ids)
    assert sum(t == "hot" for t, _ in held) > 3 and max(len(ids) for _, ids in held) < 400
    once = M.index_texts(table)
    assert once.filter(F.col("text").cast("string").startswith("text")).count() == 7  # one entry for each text that is not hot
    assert digests(M.cut(index), "id") == sorted((brute(str(i), t) for i, t in rows), key=repr)


def test_an_index_is_cut_again_with_another_seed_and_ids_may_be_words(spark):
    rows = [(f"d-{i}", "some longer text " * (i % 5)) for i in range(80)]
    found = M.fill_in_middle(spark.createDataFrame(rows, "name string, body string"), id_col="name", text_col="body", seed=42)
    assert found.columns[0] == "name"
    assert digests(found, "name") == sorted((brute(*r, seed=42) for r in rows), key=repr)


def test_a_very_long_text(spark, docs):
    rows = [(5, "añb " * 2_000_000), (8, "z" * 5_000_000)]
    assert digests(M.fill_in_middle(docs(rows))) == sorted((brute(*r) for r in rows), key=repr)


@given(st.text(max_size=900))
@settings(max_examples=150, deadline=None)
def test_boundaries_are_those_of_the_code_points(text):
    data = text.encode("utf-8", "ignore")
    text = data.decode()
    b = M.boundaries(data)
    assert b.count == len(text) + 1
    assert [b.select(k) for k in range(b.count)] == [len(text[:k].encode()) for k in range(b.count)]


@pytest.mark.parametrize("size", [0, 1, 10, 4_000, 10**7])
def test_lists_of_any_density(size):
    rng = np.random.default_rng(size)
    values = np.sort(rng.integers(0, size + 1, 1000))
    e = M.EliasFano.of(values, size)
    assert [e.select(k) for k in range(1000)] == values.tolist()
    assert len(e.low) + len(e.high) <= (1000 * (2 + max(0, (size // 1000).bit_length()))) / 8 + 4
