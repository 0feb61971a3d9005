"""Fill-in-the-middle examples over an index of distinct texts.

Index.  Documents with the same text share one entry.  Copies within an Arrow batch are
put together before anything is shuffled; rows then meet by a 64-bit hash of the text, and
within a hash texts are compared byte by byte, so a collision only makes two entries.  For
each entry the byte offsets of its code points are computed once and kept as an Elias-Fano
list: the lower bits side by side, the upper ones in unary, and the place of every
SAMPLE-th value, from which any boundary is selected without decoding the text.  The ids
of an entry's documents ride along, which joins it back to them.

A text that more than COPIES documents have gets an entry for each slice of its documents
(about COPIES of them, dealt by input partition), so no task gathers a hot text.

Cut.  Each document draws two boundaries and a form from the SHA-256 of seed and id, and
takes its prefix, middle and suffix as byte ranges between selected boundaries.  An index
can be stored and cut again with other seeds.

Defined results: a null text counts as empty, and empty texts are plain; texts that hold
a marker are plain, as they could not be restored; a null id draws from the seed and a
colon alone; repeated rows give repeated results; other columns are not read; an empty
table gives an empty result; texts that are not valid UTF-8 are cut before bytes that
begin a code point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import bounded_broadcast

#: Fixed values of the format: markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Documents of a slice of a hot text (about); boundaries between two sampled ones.
COPIES, SAMPLE = 256, 256
#: Entries that are put together to one Arrow batch.
ROWS, BYTES = 256, 8_000_000

INDEX = "text binary, ids array<string>, n bigint, size bigint, low_bits int, low binary, high binary, samples array<bigint>"
CUT = "id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, suffix_chars bigint, output binary"


@dataclass(frozen=True)
class EliasFano:
    """A rising list of ``count`` values up to ``size``."""

    count: int
    size: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, size: int) -> EliasFano:
        count = len(values)
        low_bits = max(0, ((size + 1) // max(count, 1)).bit_length() - 1)
        place = (values >> low_bits) + np.arange(count)
        upper = np.zeros((size >> low_bits) + count + 1, bool)
        upper[place] = True
        lower = ((values[:, None] >> np.arange(low_bits)) & 1).astype(bool)
        return cls(count, size, low_bits, np.packbits(lower, bitorder="little").tobytes(), np.packbits(upper, bitorder="little").tobytes(), place[::SAMPLE])

    def select(self, k: int) -> int:
        """Value k, counted from 0: the k-th set bit is looked for from the sampled one before it."""
        at, rest = divmod(k, SAMPLE)
        begin = int(self.samples[at])
        end = int(self.samples[at + 1]) if at + 1 < len(self.samples) else 8 * len(self.high)
        first = begin >> 3
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[first : (end >> 3) + 1], bitorder="little")
        place = 8 * first + int(np.flatnonzero(bits[begin - 8 * first :])[rest]) + begin - 8 * first
        low = 0
        for b in range(self.low_bits):
            i = k * self.low_bits + b
            low |= (self.low[i >> 3] >> (i & 7) & 1) << b
        return (place - k << self.low_bits) | low


def boundaries(text: bytes) -> EliasFano:
    """Byte offsets at which code points begin, and the end."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return EliasFano.of(np.append(starts, len(text)), len(text))


def _together(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of equal text and slice as one, with the list of their ids."""
    texts, slices = batch.column(1).dictionary_encode(), batch.column(3).to_numpy()
    code = texts.indices.to_numpy().astype(np.int64)
    _, first, group = np.unique(np.stack([code, slices]), axis=1, return_index=True, return_inverse=True)
    group = group.ravel()
    order = np.argsort(group, kind="stable")
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))]), pa.int32())
    ids = pa.ListArray.from_arrays(offsets, batch.column(0).take(pa.array(order)))
    at = pa.array(first)
    return pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(3).take(at), batch.column(1).take(at), ids], names=["key", "slice", "text", "ids"])


def index_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, copies: int = COPIES) -> DataFrame:
    """One row for each distinct text (and slice, for hot ones): text, ids, n (code points) and its boundary list.

    ``key`` is any hash of the text (column ``text``, binary); it decides where rows meet, never which are equal.
    """
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    own = own.withColumn("key", F.xxhash64("text") if key is None else key)
    counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > copies)
    hot = materialize(counts.select("key", F.ceil(F.col("n") / copies).cast("int").alias("slices")), "hot_texts")
    told = own.withColumn("part", F.spark_partition_id()).join(bounded_broadcast(hot), "key", "left")
    sliced = told.select("id", "text", "key", F.coalesce(F.pmod(F.xxhash64("part"), F.col("slices")).cast("int"), F.lit(0)).alias("slice"))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _together(batch)

    dealt = sliced.mapInArrow(together, "key bigint, slice int, text binary, ids array<string>")
    dealt = dealt.repartition("key", "slice").sortWithinPartitions("key", "slice")
    schema = pa.schema(
        [("text", pa.binary()), ("ids", pa.list_(pa.string())), ("n", pa.int64()), ("size", pa.int64()), ("low_bits", pa.int32()),
         ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.list_(pa.int64()))]
    )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now, held = [], 0, None, {}

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        def close() -> int:
            for text, ids in held.items():
                b = boundaries(text)
                out.append((text, ids, b.count - 1, b.size, b.low_bits, b.low, b.high, b.samples.tolist()))
            return sum(map(len, held))

        for batch in batches:
            for one, part, text, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (one, part) != now:
                    size += close()
                    now, held = (one, part), {}
                    if len(out) >= ROWS or size >= BYTES:
                        yield full()
                        out, size = [], 0
                held.setdefault(text, []).extend(ids)
        close()
        if out:
            yield full()

    return dealt.mapInArrow(entries, INDEX)


def drawn(seed: int, doc_id: str | None) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def cut(index: DataFrame, *, seed: int = 1, rate: int = 90, swapped: int = 20) -> DataFrame:
    """id (as a string), n, form, prefix_chars, middle_chars, suffix_chars and output of every document of the index.

    ``rate`` of a hundred documents are cut, ``swapped`` of a hundred of those have the suffix first.
    """
    fields = [("id", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("suffix_chars", pa.int64()), ("output", pa.binary())]
    schema = pa.schema(fields)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i].as_py() for name in ("text", "ids", "n", "size", "low_bits", "low", "high", "samples")}
                text, n = r["text"], r["n"]
                ends = EliasFano(n + 1, r["size"], r["low_bits"], r["low"], r["high"], np.array(r["samples"]))
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                for doc in r["ids"]:
                    h1, h2, h3, h4 = drawn(seed, doc)
                    if not n or marked or h3 % 100 >= rate:
                        out.append((doc, n, "plain", None, None, None, text))
                    else:
                        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                        p, q = ends.select(a), ends.select(b)
                        form = "spm" if h4 % 100 < swapped else "psm"
                        parts = (SUFFIX, text[q:], PREFIX, text[:p], MIDDLE, text[p:q]) if form == "spm" else (PREFIX, text[:p], SUFFIX, text[q:], MIDDLE, text[p:q])
                        out.append((doc, n, form, a, b - a, n - b, b"".join(parts)))
                    size += len(text)
                    if len(out) >= ROWS or size >= BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return index.mapInArrow(examples, CUT).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made from, by its markers alone."""
    body = F.substr(output, F.lit(4))
    second = F.when(form == "psm", F.lit(SUFFIX.decode())).otherwise(F.lit(PREFIX.decode()))
    head, rest = F.substring_index(body, SUFFIX.decode(), 1), F.substring_index(body, PREFIX.decode(), 1)
    first = F.when(form == "psm", head).otherwise(rest)
    after = F.substr(body, F.length(first) + F.length(second) + 1)
    then, middle = F.substring_index(after, MIDDLE.decode(), 1), F.substring_index(after, MIDDLE.decode(), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, then)).otherwise(F.concat(then, middle, first))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, swapped: int = 20) -> DataFrame:
    """``cut`` of ``index_texts``, with ids of their own type."""
    found = cut(index_texts(docs, id_col=id_col, text_col=text_col), seed=seed, rate=rate, swapped=swapped)
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *found.columns[1:])


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = F.sha2("output", 256).alias("output_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {"op12_fill_middle": op12_fill_middle}
ORACLES: dict[str, str] = {}
