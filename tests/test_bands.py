"""A band's blocks are made in one task, in a build and in a merge, and deletions are found by band."""

from pyspark.sql import functions as F

from tests.test_sizes_of_search import COLUMNS, docs
from traceframe.operators import text_index as T


def files_of_bands(spark, index):
    """Most files that one band's blocks are in."""
    stored = spark.read.parquet(f"{index.segments[0].path}/blocks").select("band", F.input_file_name().alias("file"))
    return stored.groupBy("band").agg(F.countDistinct("file").alias("n")).agg(F.max("n"), F.countDistinct("band")).first()


def test_bands_lie_in_one_file_and_hold_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BAND", 16)
    monkeypatch.setattr(T, "parts", lambda amount, each=0: 5, raising=False)
    index = T.create(docs(spark, 300, 4), str(tmp_path / "i"), "id", COLUMNS)
    index = T.add(index, docs(spark, 200, 5, 1_000))
    index = T.remove(index, docs(spark, 300, 4).filter("id % 3 = 0"))
    for found in (index, T.merge(spark, index)):
        most, bands = files_of_bands(spark, found)
        assert most == 1 and bands > 5
        rows = spark.read.parquet(f"{found.segments[0].path}/blocks")
        assert rows.agg(F.max("n")).first()[0] <= 4 * T.BAND  # dealt by a hash


def test_many_deletions_are_shuffled_by_band(spark, tmp_path, monkeypatch):
    table = docs(spark, 200, 6).cache()
    index = T.remove(T.create(table, str(tmp_path / "i"), "id", COLUMNS), table.filter("id % 2 = 0"))
    index = T.add(index, table.filter("id % 4 = 0"))
    want = sorted(map(tuple, T.live_postings(spark, T.create(table.filter("id % 4 <> 2"), str(tmp_path / "f"), "id", COLUMNS)).collect()))
    for keys in (T.DEAD_KEYS, 0):
        monkeypatch.setattr(T, "DEAD_KEYS", keys)
        assert sorted(map(tuple, T.live_postings(spark, index).collect())) == want
    assert sorted(map(tuple, T.live_postings(spark, T.merge(spark, index)).collect())) == want
