"""Token ids as binary files, one zstandard frame for each document.

Layout of a written folder (two Parquet tables, so any store that Spark writes will do):

``dictionary``  one row: ``dict_hash`` (SHA-256 of the dictionary), ``data`` (the
                zstandard dictionary, trained on serialized id arrays), ``width`` (2 or
                4 bytes an id, little-endian).
``blocks``      rows of up to ``BLOCK_DOCS`` documents in ascending order of doc_id:
                ``shard``, ``block``, ``first_id``, ``last_id``, ``rel_start`` (ids in the
                shard before the block), ``doc_ids``, ``n_tokens``, ``offsets`` (where
                each frame begins in ``payload``; one more gives the end), ``payload``
                (the frames) and ``dict_hash``.

A short document is read by its offset alone, without its neighbours' frames.

Defined results: a null text counts as empty and has the end id alone; a null doc_id
sorts first; repeated ids keep a fixed order (by number of tokens, then by frame); other
columns are not read; an empty table gives empty blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.llm.tokens import encoder, public_path
from traceframe.plans.scratch import materialize, scratch_path
from traceframe.plans.sizing import bounded_broadcast

END_ID = 2
#: The dictionary is trained on about so many documents, chosen by a hash of the id, and on so many bytes of each: at most 16 MB.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES, LEVEL = 1_000, 8_192, 65_536, 3
BLOCK_DOCS, BLOCK_BYTES = 512, 4_000_000
BLOCKS = (
    "shard int, block int, first_id bigint, last_id bigint, rel_start bigint, doc_ids array<bigint>, "
    "n_tokens array<bigint>, offsets array<bigint>, payload binary, dict_hash string"
)


def _narrow(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes()


def _sampled(docs: DataFrame) -> DataFrame:
    """About SAMPLE_DOCS rows, and at most twice as many."""
    n = docs.select("doc_id").count()
    part = int(min(1.0, SAMPLE_DOCS / max(n, 1)) * (1 << 30))
    return docs.filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 30)) < part).limit(2 * SAMPLE_DOCS)


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end: bytes) -> bytes:
    """Dictionary trained on the sample; empty if the sample is too small to train on."""

    kind = encoder(tokenizer).kind

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kind)
        for batch in batches:
            found = [_narrow(x + end, width)[:SAMPLE_BYTES] for x in enc.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["data"])

    rows = _sampled(docs).mapInArrow(ids, "data binary").collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(bytes(r.data) for r in rows)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _zdict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, *, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every document and write the folder described above."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    width = 2 if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = end_id.to_bytes(4, "little")
    kind = encoder(tokenizer).kind
    data = train_dictionary(own, tokenizer, width, end)
    dict_hash = hashlib.sha256(data).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(data), width)], "dict_hash string, data binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer, kind), zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(data))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 512):
                found = [x + end for x in enc.encode(texts[lo : lo + 512].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [ids[lo : lo + 512], pa.array([len(x) // 4 for x in found], pa.int64()),
                     pa.array([packer.compress(_narrow(x, width)) for x in found], pa.binary())],
                    names=["doc_id", "n_tokens", "frame"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row() -> pa.RecordBatch:
            ids, counts, parts = zip(*held, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).tolist()
            known = [i for i in ids if i is not None]
            values = [shard, block, min(known, default=None), max(known, default=None), before, list(ids), list(counts), offsets, b"".join(parts), dict_hash]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(one)
                size += len(one[2])
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield row()
                    before += sum(x[1] for x in held)
                    block, held, size = block + 1, [], 0
        if held:
            yield row()

    longs = pa.list_(pa.int64())
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("rel_start", pa.int64()),
         ("doc_ids", longs), ("n_tokens", longs), ("offsets", longs), ("payload", pa.binary()), ("dict_hash", pa.string())]
    )
    encoded = materialize(own.mapInArrow(frames, "doc_id bigint, n_tokens bigint, frame binary"), "frames")
    order = ["doc_id", "n_tokens", "frame"]
    ranged = encoded.repartitionByRange("doc_id", "n_tokens", F.crc32("frame")).sortWithinPartitions(*order[:2], F.crc32("frame"), "frame")
    ranged.select(*order).mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.data)).hexdigest() != row.dict_hash:
        raise ValueError(f"{path}/dictionary is damaged: its hash does not match")
    return row.dict_hash, bytes(row.data), row.width


def read_tokens(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of all documents, or of one.

    ``start`` counts the ids of all documents before.  The totals of the shards, one row
    for each write task, are summed up in one window; blocks carry the rest.
    """
    dict_hash, data, width = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    total = F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")
    shards = blocks.groupBy("shard").agg(F.sum(total).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    if doc_id is not None:
        blocks = blocks.filter(F.lit(doc_id).between(F.col("first_id"), F.col("last_id")))
    placed = blocks.join(bounded_broadcast(materialize(starts, "starts")), "shard").select(
        (F.col("shard_start") + F.col("rel_start")).alias("start"), "doc_ids", "n_tokens", "offsets", "payload", "dict_hash"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_zdict(data))
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_hash"] != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                out, at, frames = [], r["start"], memoryview(r["payload"])
                for doc, n, lo, hi in zip(r["doc_ids"], r["n_tokens"], r["offsets"], r["offsets"][1:], strict=False):
                    if doc_id is None or doc == doc_id:
                        ids = np.frombuffer(opener.decompress(frames[lo:hi]), f"<u{width}").astype("<u4").tobytes()
                        out.append((doc, at, len(ids) // 4, ids, zlib.crc32(ids)))
                    at += n
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names, types = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"], [pa.int64()] * 3 + [pa.binary(), pa.int64()]
    return placed.mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("word_bpe_49k.json"), path)
    return read_tokens(spark, path).drop("ids")


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict[str, str] = {}
