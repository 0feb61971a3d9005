"""One-to-one alignment of two lists of entries, and the cause of every entry that has no counterpart.

Entries of both sides have a place on a line (within a file, say) and match if they are at
most ``tolerance`` apart; each is matched once, the earliest ones first, which matches as
many as can be.  A gap of more than the tolerance parts entries that cannot touch each
other, so a group is cut there and its stretches are dealt out by themselves: a group that
holds a third of all entries is many small ones.  Within a stretch both lists are passed
once, and only entries that still wait for a partner are held.

``causes`` deals out files of up to FILE_ROWS entries by file and tries all causes in one pass,
as nothing reaches from one file to another; only longer files are aligned cause by cause.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import bounded_broadcast, parts

#: Rows of an Arrow batch that are given back; most entries of a file that a task holds at once.
ROWS, FILE_ROWS = 4_096, 10_000


def align(entries: DataFrame, by: list[str], place: str, side: str, entry: str, tolerance: int, order: list[str] | None = None) -> DataFrame:
    """entry, side and partner (the entry matched on the other side, or null) of all ``entries``.

    ``side`` is 0 or 1, ``entry`` a number that is unique within its side; entries of one
    place are taken in the order of ``order``, then by number.
    """
    group = Window.partitionBy(*by).orderBy(place, side, *(order or []), entry)
    apart = (F.col(place) - F.lag(place).over(group) > tolerance).cast("int")
    stretch = F.coalesce(F.sum(apart).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    keys = [F.col(c).alias(f"by{i}") for i, c in enumerate(by)]
    told = entries.withColumn("stretch", stretch).select(F.xxhash64(*by, "stretch").alias("key"), F.col(place).cast("bigint").alias("place"), F.col(side).cast("int").alias("side"), F.col(entry).cast("bigint").alias("entry"), "stretch", *keys, *[F.col(c).alias(f"order{i}") for i, c in enumerate(order or [])])
    names = [f"by{i}" for i in range(len(by))]
    dealt = told.repartition("key").sortWithinPartitions("key", *names, "stretch", "place", "side", *[f"order{i}" for i in range(len(order or []))], "entry")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, whose, out = None, deque(), 0, []  # all that wait are of one side

        def full() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["entry", "side", "partner"])

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("place", "side", "entry", "stretch", *names)}
            for i in range(batch.num_rows):
                at, mine, me = columns["place"][i], columns["side"][i], columns["entry"][i]
                group = (columns["stretch"][i], *(columns[n][i] for n in names))
                while waiting and (group != now or waiting[0][0] < at - tolerance):
                    out.append((waiting.popleft()[1], whose, None))
                now = group
                if waiting and whose != mine:
                    other = waiting.popleft()[1]
                    out += [(other, whose, me), (me, mine, other)]
                else:
                    waiting.append((at, me))
                    whose = mine
            while len(out) >= ROWS:
                yield full()
                out = []
        out += [(me, whose, None) for _, me in waiting]
        if out:
            yield full()

    return dealt.mapInArrow(matched, "entry bigint, side int, partner bigint")


def causes(reference: DataFrame, index: DataFrame, file: str, role: str, place: str, entry: str, *, tolerance: int, far: int) -> DataFrame:
    """side (0 reference, 1 index), entry, cause and partner of every entry of both sides; each has exactly one cause.

    The causes are tried in order, each over what the ones before have left: ``same`` place
    and role, ``near`` (the same role within the tolerance), ``other role`` (within the
    tolerance), ``moved`` (the same role within ``far``); then ``unknown file``, which
    the other side does not have, and ``missing`` or ``extra``.
    """
    columns = [file, role, place, entry]
    steps = [("same", True, 0), ("near", True, tolerance), ("other role", False, tolerance), ("moved", True, far)]
    left = materialize(reference.select(*columns, F.lit(0).alias("side")).unionByName(index.select(*columns, F.lit(1).alias("side"))), "entries")
    long = materialize(left.groupBy(file).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FILE_ROWS).select(F.struct(file).alias("long")), "long_files")
    if long.isEmpty():
        return _by_file(left, file, role, place, entry, steps)
    held = left.join(bounded_broadcast(long), F.struct(file).eqNullSafe(F.col("long")), "left").withColumn("long", F.col("long").isNotNull())
    held = materialize(held, "entries_by_length")
    few = _by_file(held.filter("not long").drop("long"), file, role, place, entry, steps)
    return few.unionByName(_by_cause(held.filter("long").drop("long"), file, role, place, entry, steps))


def _by_file(entries: DataFrame, file: str, role: str, place: str, entry: str, steps: list[tuple[str, bool, int]]) -> DataFrame:
    """``causes`` of files of few entries: a file is held in one task, and passed once for each cause."""

    def told(rows: list[tuple]) -> list[tuple]:
        """side, entry, cause and partner of a file's entries (place, side, role, entry), which are in order."""
        if len({r[1] for r in rows}) == 1:
            return [(r[1], r[3], "unknown file", None) for r in rows]
        out, left = [], rows
        for cause, with_role, within in steps:
            waiting, whose, matched = {}, {}, set()  # for each role, all that wait are of one side
            for r in left:
                of = r[2] if with_role else None
                queue = waiting.setdefault(of, deque())
                while queue and queue[0][0] < r[0] - within:
                    queue.popleft()
                if queue and whose[of] != r[1]:
                    other = queue.popleft()
                    out += [(other[1], other[3], cause, r[3]), (r[1], r[3], cause, other[3])]
                    matched |= {(other[1], other[3]), (r[1], r[3])}
                else:
                    queue.append(r)
                    whose[of] = r[1]
            left = [r for r in left if (r[1], r[3]) not in matched] if matched else left
        return out + [(r[1], r[3], ("missing", "extra")[r[1]], None) for r in left]

    def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["side", entry, "cause", "partner"])

        now, rows, out = None, [], []
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and name != now:
                    out += told(rows)
                    rows = []
                    if len(out) >= ROWS:
                        yield batch_of(out)
                        out = []
                now = name
                rows.append(tuple(row))
        out += told(rows) if rows else []
        if out:
            yield batch_of(out)

    own = entries.select(file, F.col(place).cast("bigint").alias("place"), "side", role, F.col(entry).cast("bigint").alias("entry"))
    dealt = own.toDF("file", "place", "side", "role", "entry").repartition(parts(entries.count()), "file").sortWithinPartitions("file", "place", "side", "role", "entry")
    return dealt.mapInArrow(by_file, f"side int, `{entry}` bigint, cause string, partner bigint")


def _by_cause(left: DataFrame, file: str, role: str, place: str, entry: str, steps: list[tuple[str, bool, int]]) -> DataFrame:
    """``causes`` of files of many entries: they are aligned for each cause, and stretches dealt out."""
    columns = [file, role, place, entry]
    known = left.groupBy(file).agg(F.countDistinct("side").alias("sides"))
    done = None
    for cause, with_role, within in steps:
        pairs = align(left, [file, role] if with_role else [file], place, "side", entry, within, [] if with_role else [role])
        told = materialize(left.join(pairs.filter("partner is not null"), [entry, "side"], "left"), "aligned")
        part = told.filter("partner is not null").select("side", entry, F.lit(cause).alias("cause"), "partner")
        done = part if done is None else done.unionByName(part)
        left = told.filter("partner is null").select(*columns, "side")
    rest = F.when(F.col("sides") == 1, "unknown file").when(F.col("side") == 0, "missing").otherwise("extra")
    return done.unionByName(left.join(known, file).select("side", entry, rest.alias("cause"), F.lit(None).cast("bigint").alias("partner")))
