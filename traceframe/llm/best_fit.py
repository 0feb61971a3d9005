"""Best-fit packing by exact complements.

A piece's length is all that matters for where it fits, so the packing is planned on the
counts of pieces by length: at most ``capacity`` numbers, however large the corpus.  A
plan is a list of patterns (lengths that share a sequence) with how often each is used.

Planning.  The longest length left opens a pattern.  Its gap is closed exactly, if that is
possible, by a single length, by a pair or by three lengths whose sum is the gap; they are
looked up in an index of the lengths that are available and of the sums of two of them.
If no combination closes the gap, the longest length that fits goes in and the smaller
gap is tried again.  A pattern is used as often as its lengths are available, so each one
uses up a length, and the number of patterns does not grow with the corpus.  What never
closes exactly is put where it leaves the least room: residuals, best fit by decreasing
length.

Placing.  A task numbers its pieces of each length as it makes them.  Counts by task and
length, added up over the tasks, turn these into numbers over the whole table without
gathering the pieces of a length; a number's place in the plan is found in the sorted
ranges of its slots.

Defined results: a null text counts as empty and has the end id alone; repeated rows are
packed once each; a null id stays null; columns other than the id and the text are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.llm.tokens import encoder, public_path, tokenizer_kind
from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import bounded_broadcast

CAPACITY, END_ID = 4096, 1
#: Pieces of one length are counted below 2 ** NUMBER_BITS.
NUMBER_BITS = 44


class Complements:
    """Available lengths with their counts, and an index of the sums of two of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.pairs = np.zeros(capacity + 1, np.int64)  # unordered pairs of different available lengths, by their sum
        self.there = np.zeros(capacity + 1, bool)
        for length in np.flatnonzero(self.left):
            self._flip(int(length), True)

    def _flip(self, length: int, there: bool) -> None:
        """Let a length appear or go: the sums with every other one change by one."""
        self.there[length] = False
        most = self.capacity - length
        if most > 0:
            self.pairs[length:] += (1 if there else -1) * self.there[: most + 1]
        self.there[length] = there

    def take(self, pattern: list[int]) -> int:
        """Use a pattern as often as its lengths allow."""
        wanted = Counter(pattern)
        times = int(min(self.left[x] // n for x, n in wanted.items()))
        for x, n in wanted.items():
            self.left[x] -= times * n
            if not self.left[x]:
                self._flip(x, False)
        return times

    def longest(self, room: int, used: Counter) -> int:
        """The longest length up to ``room`` of which more is left than the pattern uses; 0 if none."""
        for x in np.flatnonzero(self.there[: room + 1])[::-1]:
            if self.left[x] > used[int(x)]:
                return int(x)
        return 0

    def closing(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three lengths with the sum ``gap``, long ones first; None if there are none."""
        spare = self.there[: gap + 1].copy()
        for x, n in used.items():
            if x <= gap and self.left[x] <= n:
                spare[x] = False
        if spare[gap]:
            return [gap]
        pair = self._pair(gap, spare, used)
        if pair:
            return pair
        rest = gap - np.flatnonzero(spare)[::-1]
        likely = rest[(self.pairs[rest] > 0) | ((rest % 2 == 0) & self.there[rest // 2])]
        for r in likely[likely * 3 <= 2 * gap].tolist():  # the first of three is the longest
            first = gap - r
            more = used + Counter([first])
            own = spare
            if self.left[first] <= more[first]:
                own = spare.copy()
                own[first] = False
            pair = self._pair(r, own, more)
            if pair:
                return [first, *pair]
        return None

    def _pair(self, total: int, spare: np.ndarray, used: Counter) -> list[int] | None:
        if not self.pairs[total] and (total % 2 or not spare[total // 2]):
            return None
        half = total // 2
        low = np.flatnonzero(spare[1 : (total + 1) // 2] & spare[total - 1 : half : -1]) + 1
        if len(low):
            return [total - int(low[0]), int(low[0])]
        if total and total % 2 == 0 and spare[half] and self.left[half] >= used[half] + 2:
            return [half, half]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with how often each is used; all ``counts`` pieces are in one.

    >>> plan({6: 2, 4: 1, 3: 1, 1: 1, 5: 1}, 10)
    [((6, 4), 1), ((6, 3, 1), 1), ((5,), 1)]
    """
    free, patterns, residual = Complements(counts, capacity), [], []
    while first := free.longest(capacity, Counter()):
        pattern, gap = [first], capacity - first
        while gap:
            used = Counter(pattern)
            if close := free.closing(gap, used):
                pattern, gap = pattern + close, 0
            elif more := free.longest(gap, used):
                pattern, gap = [*pattern, more], gap - more
            else:
                break
        times = free.take(pattern)
        (patterns if not gap else residual).append((tuple(pattern), times))
    return patterns + _residuals(residual, capacity)


def _residuals(found: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length for what did not close: bins of one shape and pieces of one length are moved together."""
    counts: Counter = Counter()
    for pattern, times in found:
        for x in pattern:
            counts[x] += times
    bins: Counter = Counter()
    by_gap: dict[int, set[tuple[int, ...]]] = {}

    def change(pattern: tuple[int, ...], n: int) -> None:
        bins[pattern] += n
        shapes = by_gap.setdefault(capacity - sum(pattern), set())
        (shapes.add if bins[pattern] else shapes.discard)(pattern)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = min((g for g, shapes in by_gap.items() if g >= length and shapes), default=None)
            if gap is None:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    change((length,) * each, full)
                if rest:
                    change((length,) * rest, 1)
                break
            shape = min(by_gap[gap])
            n = min(left, bins[shape])
            change(shape, -n)
            change((*shape, length), n)
            left -= n
    return sorted((p, n) for p, n in bins.items() if n)[::-1]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, how many, first sequence, offset) of each place in a pattern, numbers counted within a length."""
    out, seen, sequence = [], Counter(), 0
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            out.append((length, seen[length], times, sequence, at))
            seen[length] += times
            at += length
        sequence += times
    return out


def pieces(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: id, piece, start, length, ids_crc32, and ``shard`` and ``nth`` (number among the task's pieces of this length).

    ``with_ids`` adds the ids as little-endian unsigned 32-bit integers.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = [("piece", pa.int32(), "int"), ("start", pa.int64(), "bigint"), ("length", pa.int64(), "bigint"), ("ids_crc32", pa.int64(), "bigint"), ("shard", pa.int32(), "int"), ("nth", pa.int64(), "bigint")]
    named += [("ids", pa.binary(), "binary")] * with_ids
    end, kind = end_id.to_bytes(4, "little"), tokenizer_kind(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seen = encoder(tokenizer, kind), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, rows, who = batch.slice(lo, 512), [], []
                for i, data in enumerate(enc.encode(part.column(1).to_pylist())):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        ids = data[at : at + 4 * capacity]
                        n = len(ids) // 4
                        rows.append((piece, at // 4, n, zlib.crc32(ids), shard, seen[n], ids)[: len(named)])
                        seen[n] += 1
                        who.append(i)
                columns = [part.column(0).take(pa.array(who)), *(pa.array(c, t) for c, (_, t, _) in zip(zip(*rows, strict=True), named, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(name for name, _, _ in named)])

    return own.mapInArrow(cut, ", ".join([f"id {own.schema['id'].dataType.simpleString()}", *(f"{name} {kind}" for name, _, kind in named)]))


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece with its sequence_id and its offset there; see ``pieces`` for the rest."""
    made = materialize(pieces(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col, with_ids=with_ids), "pieces")
    by_task = materialize(made.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = np.array(sorted(slots(plan(counts, capacity))), np.int64).reshape(-1, 5)
    keys, first, sequence, offset = (table[:, 0] << NUMBER_BITS) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]

    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    told = made.join(bounded_broadcast(materialize(base, "bases")), ["length", "shard"]).withColumn("number", F.col("base") + F.col("nth"))
    told = told.select("id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(batch.num_columns - 1).to_numpy()
            slot = np.searchsorted(keys, (batch.column(3).to_numpy() << NUMBER_BITS) + number, "right") - 1
            new = [pa.array(sequence[slot] + number - first[slot]), pa.array(offset[slot])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields[:-1]]
    return told.mapInArrow(place, ", ".join([*kinds, "sequence_id bigint", "offset bigint"])).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and lengths of the pieces, from ``pack(..., with_ids=True)``; a sequence is bounded by the capacity."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return held.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.length").alias("lengths"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path("word_bpe_49k.json"))


QUERIES = {"op11_best_fit": op11_best_fit}
ORACLES: dict[str, str] = {}
