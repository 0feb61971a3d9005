"""Archives: round trip, single records by offset, the index against brute force."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from traceframe.llm import warc
from traceframe.plans.scratch import materialize, scratch_path


def _files(spark, path):
    rows = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    return {"/".join(r.path.rsplit("/", 2)[1:]): bytes(r.content) for r in rows}


def _index(spark, df):
    path = scratch_path(spark, "a")
    warc.write_warc(df, path)
    return path, warc.merge_runs(materialize(warc.read_runs(spark, path), "r")).collect()


def test_warc(spark):
    rows = [(1, "http://a.com", "x"), (2, "http://a.com", "x"), (3, None, None), (None, "b", "\r\n\r\nWARC/1.1"), (2, "http://a.com", "x"), (5, "http://a c", ""), (6, "http://e/é", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("y")).withColumn("file", F.lit(3))
    _, got = _index(spark, df)
    assert [(r.url_key, r.timestamp) for r in got] == sorted((r.url_key, r.timestamp) for r in got) and len(got) == len(rows)
    assert {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got} >= {(1, "revisit", 2, 1), (2, "response", None, 1), (3, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, 2)}
    assert _index(spark, df.filter("false"))[1] == []


def test_index_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 40)
    rng = random.Random(4)
    texts = ["", "a", "\r\n\r\n", "\0\0", "naïve 中", "z" * 5_000]
    rows = [(i, f"https://www.h{rng.randint(0, 4)}.org/p{rng.randint(0, 9)}?q={i % 3}", rng.choice(texts) if rng.random() < 0.7 else f"page {i} " * rng.randint(1, 50)) for i in range(300)]
    path, got = _index(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    last, held = {}, {i: t.encode() for i, _, t in rows}
    for i, data in held.items():
        last[data] = max(i, last.get(data, i))
    digest = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    want = {(i, len(d), digest(d), "response" if last[d] == i else "revisit", None if last[d] == i else last[d]) for i, d in held.items()}
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    key = lambda r: (warc.url_key(r.url), r.timestamp, r.page_id)
    assert [key(r) for r in got] == sorted(map(key, got)) and all(r.url_key == warc.url_key(r.url) for r in got)
    files = _files(spark, path)
    for r in got:  # each record by its offset and size alone
        fields, payload, end = warc.read_record(files[r.archive][r.record_offset : r.record_offset + r.record_bytes])
        assert end == r.record_bytes and fields["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and payload == (held[r.page_id] if r.record_type == "response" else b"")
    for data in files.values():  # any gzip reader unpacks a whole file
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(list(warc.parse_warc(data)))


def test_large_records_and_files(spark, monkeypatch):
    big = "".join(random.Random(1).choices("abcdefgh", k=20_000_000))
    rows = [(1, "http://a", big), (2, "http://b", "small"), (3, "http://c", big[:9_000_000])]
    path, got = _index(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert [(r.page_id, r.payload_bytes) for r in got] == [(1, 20_000_000), (2, 5), (3, 9_000_000)]
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000)
    path, got = _index(spark, spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(md5(string(id)), 20) as html").coalesce(1))
    assert len(got) == 200 and len(_files(spark, path)) > 20
    data = warc.pack_record(warc._record({"page_id": 1, "url": "u", "payload": b"abc", "refers_to": None}))
    assert data[-1] == 0
    for broken in (data[:-9], b"no archive at all", data[:20]):
        with pytest.raises((ValueError, warc.zlib.error)):
            list(warc.parse_warc(broken))


def test_loser_tree():
    rng = random.Random(2)
    for _ in range(300):
        runs = [sorted(rng.choices(range(20), k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_digest():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")
