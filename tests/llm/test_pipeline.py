"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from traceframe.llm import quality
from traceframe.plans.scratch import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "stage"))
    return out


def test_stages_keep_the_columns_and_shrink(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "benchmark decontamination", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    counts = [s.count() for s in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_every_stage_does_its_work(stages):
    before, graded, lines, near, clean, packed = stages
    good = {r.doc_id for r in graded.select("doc_id").collect()}
    assert good <= {r.doc_id for r in before.select("doc_id").collect()}
    texts = [(r.doc_id, r.text or "") for r in lines.orderBy("doc_id").collect()]
    seen = set()
    for _, text in texts:  # no long line stands twice
        for line in (x.strip(" ") for x in text.split("\n")):
            if len(line.split(" ")) >= 5:
                assert line not in seen
                seen.add(line)
    kept = {r.doc_id for r in near.collect()}
    sets = {r.doc_id: set(zip(*[(r.text or "").lower().split()[k:] for k in range(5)], strict=False)) for r in lines.collect()}
    for i in kept:
        for j in kept:
            if i < j and sets[i] and sets[j]:
                assert 100 * len(sets[i] & sets[j]) < 80 * len(sets[i] | sets[j])
    held = {r.doc_id for r in clean.collect()}
    assert held <= kept and {r.doc_id for r in packed.select("doc_id").distinct().collect()} == held
    total = {r.doc_id: r.doc_tokens for r in packed.collect()}
    by = {}
    for r in packed.collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    assert by == total


def test_copies_and_leaks_go_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3_000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    leak = text(30)
    rows = [(i, text(120)) for i in range(20)]
    rows += [(30, rows[0][1]), (31, " ".join([*rows[1][1].split()[:-1], "changed"])), (32, text(40) + "\n" + leak + "\n" + text(40)), (33, None), (34, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {*range(20), 33, 34}
    assert quality.grades(spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")).select("grade").collect()[0].grade == 0


def test_short_lines_stand_once(stages):
    texts = [r.text or "" for r in stages[2].orderBy("doc_id").collect()]
    lines = [x.strip(" ") for t in texts for x in t.split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
