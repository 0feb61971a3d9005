"""Packing by power-of-two decomposition.

A document of n tokens becomes n // 2048 pieces of 2048 tokens and one piece for each
binary digit of the rest, longest first.  Each piece is a sequence of its own whose
length is a power of two, so no sequence crosses documents and none is padded.  Sequences
of equal length are one bucket, named by the exponent: ``write_buckets`` lays them out in
a folder each, from which batches of one shape are read.

Defined results: a null text counts as empty and has the end id alone; repeated rows
are packed once each; a null doc_id stays null; columns other than the id and the
text are not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.memory import give_back
from traceframe.llm.tokens import CACHE_ENTRIES, encoder, public_path, tokenizer_kind

MAX_LENGTH, END_ID = 2048, 1
#: Words that a worker remembers if it is to stay small.
FEW_ENTRIES = 100_000
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, ids_crc32 bigint, "
    "doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"
)


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens, longest first; longest is a power of two.

    >>> piece_lengths(4096 + 5)
    [2048, 2048, 4, 1]
    """
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, longest: int = MAX_LENGTH, id_col: str = "doc_id",
    text_col: str = "text", keep_cache: bool = True,
) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers.

    ``keep_cache`` lets a worker keep its cache of words for its next task; without it,
    tasks are slower and workers small.

    One pass over the documents without a shuffle.  ``sequence_id`` is the task's number
    times 2**33 plus a running number, so it is unique, and a task that runs again gives
    the same ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
         ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())]
    )
    end, kind = end_id.to_bytes(4, "little"), tokenizer_kind(tokenizer)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer, kind), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 512):
                rows = []
                for doc, data in zip(ids[lo : lo + 512], enc.encode(texts[lo : lo + 512].to_pylist(), CACHE_ENTRIES if keep_cache else FEW_ENTRIES), strict=True):
                    data += end
                    total, at = len(data) // 4, 0
                    for n in piece_lengths(total, longest):
                        part = data[4 * at : 4 * (at + n)]
                        rows.append((doc, at, n, part, zlib.crc32(part), total, sequence, 0, n.bit_length() - 1))
                        sequence += 1
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )
        if not keep_cache:
            enc.forget()
            give_back()

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(pieces, SCHEMA)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences in one folder for each bucket, that is for each length."""
    packed.write.partitionBy("bucket").parquet(path)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_path("byte_bpe_50k.json")).drop("ids")


QUERIES = {"op10_pack": op10_pack}
ORACLES: dict[str, str] = {}
