"""WARC archives of pages, and a global capture index merged from local runs.

Writing.  Records with equal payloads have one full ``response`` (the largest page_id);
the others are ``revisit`` records that name it.  A record is a gzip member of its own
(several, if it has MEMBER_BYTES or more), so it is read by its offset and size alone.
Spark's text writer writes the files to any store: a member of less than 16 MB ends in a
zero byte, the highest of its size, and that byte is the writer's separator.  A task
begins a new file when its records have FILE_BYTES.

Reading.  Each archive file is unpacked record by record and gives one run of index
entries, sorted by (URL key, timestamp, page_id); offsets and sizes count packed bytes.

Merging.  Entries are dealt out by ranges of that key; what a task gets are sorted pieces
of runs, and a loser tree merges them, so the tasks in order hold the globally ordered
capture histories.  A range splits even the history of one URL, so a hot host or URL is
no hot task.

Defined results: a null payload counts as empty; a null URL has the key ``-``; a null
page_id writes no refers-to and counts as the smallest; rows repeated as a whole are
captures of their own; other columns are not read; an empty table writes no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize, scratch_path
from traceframe.plans.sizing import bounded_broadcast

#: Payloads under this many bytes are never revisits; about so many packed bytes and entries go to a file and a range.
MIN_BYTES, FILE_BYTES, RANGE_ROWS = 0, 24_000_000, 50_000
#: Unpacked bytes of a gzip member: less than 2 ** 24, so that the last byte of its size is zero.
MEMBER_BYTES = 1 << 23
#: Without a capture time of its own, a page is captured so many seconds after this moment as its id says.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)

ENTRY = (
    "url_key string, timestamp string, page_id bigint, url string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to bigint, archive string, record_offset bigint, record_bytes bigint"
)
_SORT = ["url_key", "timestamp", "page_id", "archive", "record_offset"]
_HEADER = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)
_PORT = {"http": 80, "https": 443}


def url_key(url: str | None) -> str:
    """Sort key of a URL: host parts reversed, then path and query, all in lower case.

    >>> url_key("HTTPS://www.Example.com:443/A?b=1#c")
    'com,example)/a?b=1'
    """
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = [x for x in host.split(".") if x]
    if len(labels) > 1 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    place = "" if port is None or port == _PORT.get(parts.scheme) else f":{port}"
    return ",".join(reversed(labels)) + place + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """Merges k sorted lists: each step replays one leaf's path, log2(k) comparisons.

    >>> list(LoserTree([[1, 4], [], [2, 3]]))
    [1, 2, 3, 4]
    """

    def __init__(self, runs: list[list]):
        self.runs = [r for r in runs if r]
        self.at = [0] * len(self.runs)
        k = max(1, len(self.runs))
        self.losers = [-1] * k
        self.winner = self._build(1, k) if self.runs else -1

    def _less(self, a: int, b: int) -> bool:
        """Does the head of run a come first? Ended runs come last, ties go to the earlier run."""
        end_a, end_b = self.at[a] >= len(self.runs[a]), self.at[b] >= len(self.runs[b])
        if end_a or end_b:
            return not end_a if end_a != end_b else a < b
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _build(self, node: int, k: int) -> int:
        """Play the matches below a node; keep the loser there and return the winner."""
        if node >= k:
            return node - k
        a, b = self._build(2 * node, k), self._build(2 * node + 1, k)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator:
        k = len(self.runs)
        while k and self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + k) // 2
            while node >= 1:
                if self._less(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def write_warc(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES
) -> None:
    """Write the archives: ``file=*/part-*.txt``, gzip files of one member a record that are WARC 1.1 when unpacked."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = own.withColumn("sha", F.sha1("payload"))
    # The largest id of each payload that repeats; if these are few, no payload is shuffled.
    repeated = keyed.groupBy("sha").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = bounded_broadcast(materialize(repeated, "repeated"))
    marked = keyed.join(firsts, "sha", "left").select(
        "page_id", "url", "payload",
        F.when((F.length("payload") >= min_bytes) & ~F.coalesce(F.col("original") == F.col("page_id"), F.col("original").isNull()), F.col("original")).alias("refers_to"),
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                files, packed = [], []
                for r in batch.slice(lo, 200).to_pylist():
                    packed.append(pack_record(_record(r)))
                    files.append(written // FILE_BYTES)
                    written += len(packed[-1])
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array([x[:-1] for x in packed], pa.binary())], names=["file", "record"])

    written = marked.mapInArrow(records, "file int, record binary").select("file", F.col("record").cast("string").alias("value"))
    written.write.partitionBy("file").option("lineSep", "\0").text(path)


def pack_record(record: bytes) -> bytes:
    """The record as gzip members; the last byte is zero."""
    out = []
    for lo in range(0, len(record), MEMBER_BYTES):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(packer.compress(record[lo : lo + MEMBER_BYTES]) + packer.flush())
    return b"".join(out)


def unpack_member(data: bytes | memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member that begins at a byte, unpacked, and the byte after it."""
    unpacker, out = zlib.decompressobj(31), []
    while not unpacker.eof:
        part = data[at : at + 65_536]
        if not len(part):
            raise ValueError("a record is cut off")
        out.append(unpacker.decompress(part))
        at += len(part)
    return b"".join(out), at - len(unpacker.unused_data)


def _record(r: dict) -> bytes:
    page, payload, revisit = r["page_id"], r["payload"], r["refers_to"] is not None
    date = (EPOCH + timedelta(seconds=max(0, page or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    url = re.sub(r"\s", "%20", r["url"] or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r['refers_to']}>"]
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_record(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and payload of the record that begins at a byte of a packed archive, and the byte after it."""
    record, end = unpack_member(data, at)
    while True:
        head = _HEADER.match(record)
        if head:
            fields = dict(x.split(": ", 1) for x in head[1].decode("utf-8", "surrogatepass").split("\r\n"))
            stop = head.end() + int(fields["Content-Length"])
            if record[stop : stop + 4] == b"\r\n\r\n":
                return fields, record[head.end() : stop], end
        if end >= len(data):
            raise ValueError(f"no whole WARC record at byte {at}")
        more, end = unpack_member(data, end)
        record += more


def parse_warc(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Headers, offset, size and payload of each record of a packed archive."""
    at = 0
    while at < len(data):
        fields, payload, end = read_record(data, at)
        yield fields, at, end - at, payload
        at = end


def _entry(fields: dict[str, str], offset: int, size: int, payload: bytes, archive: str) -> tuple:
    number = lambda x: int(m[1]) if (m := re.search(r"page:(-?\d+)>", x)) else None
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != said or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"{archive}: the payload at byte {offset} does not fit its digest")
    url = fields["WARC-Target-URI"]
    return (
        url_key(url), re.sub(r"\D", "", fields["WARC-Date"]), number(fields["WARC-Record-ID"]), url, kind,
        int(fields["X-Payload-Length"]), said, number(fields.get("WARC-Refers-To", "")), archive, offset, size,
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of every archive; those of one archive are a sorted run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                archive = "/".join(name.rsplit("/", 2)[1:])
                found = sorted((_entry(*r, archive) for r in parse_warc(memoryview(data.as_buffer()))), key=_key)
                for lo in range(0, len(found), 5_000):
                    yield _batch(found[lo : lo + 5_000])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(runs, ENTRY)


def _key(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[8], entry[9]


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    columns = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")])


def merge_runs(runs: DataFrame) -> DataFrame:
    """The entries in global order of (url_key, timestamp, page_id), tasks in order of their ranges.

    ``runs`` has to be a stored table, as its keys are looked at once to set the ranges.
    A range has about RANGE_ROWS entries, so what one loser tree holds is bounded.
    """
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    place: list[Column] = [F.col(c) for c in _SORT]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(entry[8], []).append((_key(entry), entry))
        out = []
        for _, entry in LoserTree([own[a] for a in sorted(own)]):
            out.append(entry)
            if len(out) == 5_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    dealt = runs.repartitionByRange(ranges, *place).sortWithinPartitions("archive", *_SORT[:3], "record_offset")
    return dealt.mapInArrow(merged, ENTRY)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = merge_runs(materialize(read_runs(spark, path), "runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "archive", "record_offset", "record_bytes")


QUERIES = {"op5_warc": op5_warc}
ORACLES: dict[str, str] = {}
