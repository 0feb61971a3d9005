"""A stored keyword index: segments of posting blocks, searched by the bounds of blocks.

Layout of an index folder.  Each segment is a folder of its own, written once:

``blocks``   term, band, n, max_tf, min_length, and the postings as arrays (keys, tfs,
             lengths); each file has some bands, sorted by term.  A band is a set of up to about
             BAND rows of like size in characters; a block holds what one term has in one band, so
             blocks of different terms line up.  A row's band follows from its key and characters,
             so rows are dealt out by bands before their tokens are read, once, and postings are
             not shuffled.  The blocks of the empty term list the rows of a band that have tokens.
``deaths``   in a segment of deletions instead: key, level and length of the rows that are dead in earlier segments.
``terms``    there too: term and df, how many dead rows hold it, as a negative number.  Blocks tell how many rows of their own
             segment hold a term.

A pointer (``sources.pointers``) lists the segments with their sums: rows, rows with a
token, tokens, and rows by level of size.  All statistics are kept by addition, so adding and deleting reads only the
rows that come and go, and ``merge`` gives what a fresh build would.

Search.  The score of a posting grows with tf and falls with length, so a block's largest
tf and smallest length bound its scores, whatever the statistics are by now; the bounds of a
query's terms add up to one of the band.  For each query the bands with the highest bounds
are read first, enough of them to hold k rows; the k-th best score there is what any other
row has to reach.  Bands whose bound is less are left out.  In the others, blocks are taken
by falling bounds: where this one and the later ones together cannot reach the score, they
make no candidates.  Rows of the blocks before are scored, and only where such a row may
still reach it with what the later blocks can add, those are looked up.  The arrays of a
block that is skipped are never decoded.  Where the queries have more terms than a plan
lists, their bounds would be more rows than the postings: then the blocks are dealt out by
bands, and each task scores the rows of its bands and keeps the k best of each query.  Results
equal scoring every posting, ties and rounding included.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.operators import posting_blocks
from traceframe.operators.posting_blocks import ROWS
from traceframe.operators.search import B, K1, MAX_TERMS, MIN_IDF, token_count, tokens
from traceframe.plans.scratch import materialize
from traceframe.plans.shipping import ship
from traceframe.plans.sizing import TASK_CHARS, bounded_broadcast, characters, parts
from traceframe.sources import pointers

#: The way the folder is laid out; others are not read.
LAYOUT = 2
#: Most rows of a band (about); sizes of a band differ by this factor at most, above a few characters.
BAND, STEP = 128, 1.2
#: Bands (about) whose blocks a merge moves together.
LANE = 4
#: Bands of a query that are read first hold so many postings for each row wanted.
PROBE = 8
#: Bytes and rows of a page of blocks (about).
PAGE_BYTES, PAGE_ROWS = 128_000, 2_000
#: So many deleted keys are sent to every task; more are shuffled, by bands.
DEAD_KEYS = 4_000_000
#: Scores are rounded to so many digits, so bounds may miss by half a step.
DIGITS = 6


@dataclass(frozen=True)
class Segment:
    path: str
    dead: bool
    rows: int
    held: int
    tokens: int
    #: Rows with a character by level of size, negative in a segment of deletions; and the parts that a level's rows were dealt to.
    levels: dict[str, int]
    deal: dict[str, int]


@dataclass(frozen=True)
class Index:
    """One generation of an index: its segments in order, and what they sum up to."""

    root: str
    generation: int
    key: str
    columns: dict[str, float]
    segments: tuple[Segment, ...]

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @property
    def average(self) -> float:
        return sum(s.tokens for s in self.segments) / max(1, sum(s.held for s in self.segments))


def _told(index: Index) -> str:
    return json.dumps({"layout": LAYOUT, "key": index.key, "columns": index.columns, "segments": [asdict(s) for s in index.segments]}, sort_keys=True)


def open_index(spark: SparkSession, root: str) -> Index:
    """The latest generation of an index."""
    if (found := pointers.latest(spark, root)) is None:
        raise FileNotFoundError(f"no index in {root}")
    told = json.loads(found[1])
    if told.get("layout") != LAYOUT:
        raise ValueError(f"the index in {root} is laid out in another way: build it anew")
    return Index(root, found[0], told["key"], told["columns"], tuple(Segment(**s) for s in told["segments"]))


def _publish(spark: SparkSession, index: Index) -> Index:
    return replace(index, generation=pointers.advance(spark, index.root, _told(index), index.generation))


def _level(columns: Iterable[str]) -> Column:
    """The level of a row by its characters, which are known without reading its tokens."""
    return F.floor(F.log(F.greatest(characters(list(columns)), F.lit(1)).cast("double")) / F.log(F.lit(STEP))).cast("int")


def _deal(levels: dict[str, int]) -> dict[str, int]:
    """The parts of each level: powers of two, so a band of few rows is cut to few bands where more rows come."""
    return {x: 1 << max(0, -(-n // BAND) - 1).bit_length() for x, n in levels.items()}


def _band(key: Column, level: Column, deal: dict[str, int]) -> Column:
    """The band of a row: its level, and a part by a hash where the level has more rows than a band holds."""
    return level.cast("bigint") * (1 << 32) + F.pmod(F.xxhash64(key), _parts_of(level, deal))


def _parts_of(level: Column, deal: dict[str, int]) -> Column:
    of = F.create_map(*[F.lit(x) for item in deal.items() for x in (int(item[0]), item[1])]) if deal else F.create_map().cast("map<int,int>")
    return F.coalesce(F.try_element_at(of, level), F.lit(1))


def _levels(docs: DataFrame, columns: Iterable[str]) -> tuple[int, dict[str, int], int]:
    """Rows, rows with a character by level (a few dozen), and the characters."""
    told = docs.select(_level(columns).alias("level"), characters(list(columns)).alias("chars"))
    rows = told.groupBy("level", (F.col("chars") > 0).alias("any")).agg(F.count(F.lit(1)).alias("rows"), F.sum("chars").alias("chars")).collect()
    return sum(r.rows for r in rows), {str(r.level): r.rows for r in sorted(rows) if r.any}, sum(r.chars for r in rows)


def _segment(docs: DataFrame, root: str, key: str, columns: dict[str, float]) -> Segment:
    path = f"{root.rstrip('/')}/segment-{uuid.uuid4().hex}"
    ship(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), *columns)
    rows, levels, chars = _levels(own, columns)
    deal = _deal(levels)
    banded = own.filter(characters(list(columns)) > 0).withColumn("band", _band(F.col("key"), _level(columns), deal)).repartition(parts(chars, TASK_CHARS), "band")
    read = banded.select("key", "band", *[x for i, c in enumerate(columns) for x in _read(c, i)])
    _write_blocks(read.mapInArrow(posting_blocks.of_texts(list(columns.values())), posting_blocks.schema(own.schema["key"].dataType.simpleString())), path)
    stored = docs.sparkSession.read.parquet(f"{path}/blocks")
    listed = stored.filter(F.col("term") == ROWS).select("n", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("tokens"))
    sums = listed.agg(F.sum("n").alias("held"), F.sum("tokens").alias("tokens")).first()
    return Segment(path, False, rows, sums.held or 0, sums.tokens or 0, levels, deal)


def _read(column: str, i: int) -> tuple[Column, Column]:
    """A column's text for ``posting_blocks``, lower-cased; or its tokens, where it has a character that is left to Spark."""
    low = F.lower(F.col(column))
    odd = (F.octet_length(low) > F.length(low)) & low.rlike(posting_blocks.ODD)
    return F.when(~odd, low).alias(f"x{i}"), F.when(odd, tokens(F.col(column))).alias(f"t{i}")


def _write_blocks(blocks: DataFrame, path: str) -> None:
    """Pages are small, as a query reads those that its terms are on; terms are too many for a dictionary, and sorted."""
    pages = {"parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.enable.dictionary#term": "false"}
    blocks.write.options(compression="zstd", **pages).parquet(f"{path}/blocks")


def create(docs: DataFrame, root: str, key: str, columns: dict[str, float]) -> Index:
    """Build an index of the rows of ``docs``; ``columns`` are searched with their weights.  Keys are unique."""
    return _publish(docs.sparkSession, Index(root, 0, key, columns, (_segment(docs, root, key, columns),)))


def add(index: Index, docs: DataFrame) -> Index:
    """The index with more rows, whose keys it does not hold."""
    return _publish(docs.sparkSession, replace(index, segments=(*index.segments, _segment(docs, index.root, index.key, index.columns))))


def _deaths(index: Index, docs: DataFrame) -> Segment:
    path = f"{index.root.rstrip('/')}/deaths-{uuid.uuid4().hex}"
    own = docs.select(F.col(index.key).alias("key"), *index.columns)
    own.select("key", _level(index.columns).alias("level"), (characters(list(index.columns)) > 0).alias("any"), token_count(index.columns).alias("length")).write.parquet(f"{path}/deaths")
    words = F.array_distinct(F.concat(*[F.coalesce(tokens(F.col(c)), F.array().cast("array<string>")) for c in index.columns]))
    lost = own.select(F.explode(words).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
    lost.sortWithinPartitions("term").write.parquet(f"{path}/terms")  # each file has some terms in order, so that a query reads few row groups
    sums = docs.sparkSession.read.parquet(f"{path}/deaths").groupBy("level", "any").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("length") > 0).alias("held"), F.sum("length").alias("tokens")).collect()
    levels = {str(r.level): -r.rows for r in sorted(sums) if r.any}
    return Segment(path, True, *(-sum(r[x] for r in sums) for x in ("rows", "held", "tokens")), levels, {})


def remove(index: Index, docs: DataFrame) -> Index:
    """The index without some of its rows, which are given as they were put in."""
    return _publish(docs.sparkSession, replace(index, segments=(*index.segments, _deaths(index, docs))))


def update(index: Index, gone: DataFrame, come: DataFrame) -> Index:
    """Delete and add in one step: readers see both or neither."""
    new = (_deaths(index, gone), _segment(come, index.root, index.key, index.columns))
    return _publish(gone.sparkSession, replace(index, segments=(*index.segments, *new)))


def _losses(index: Index) -> list[tuple[int, Segment, Segment]]:
    """Each segment of postings with its number, and each later one of deletions."""
    return [(i, s, d) for i, s in enumerate(index.segments) if not s.dead for d in index.segments[i + 1 :] if d.dead]


def _dead(spark: SparkSession, index: Index) -> DataFrame | None:
    """segment, band and gone: the keys of a band that later segments have deleted."""
    pairs = _losses(index)
    if not pairs:
        return None
    found = [spark.read.parquet(f"{d.path}/deaths").filter("length > 0").select(F.lit(i).alias("segment"), _band(F.col("key"), F.col("level"), s.deal).alias("band"), "key") for i, s, d in pairs]
    gone = reduce(DataFrame.unionByName, found).groupBy("segment", "band").agg(F.collect_set("key").alias("gone"))  # at most a band's rows
    return F.broadcast(gone) if sum(-d.held for _, _, d in pairs) <= DEAD_KEYS else gone


def _blocks(spark: SparkSession, index: Index) -> DataFrame:
    """Blocks of all segments, with the segment's number; those that list rows are left out."""
    parts = [spark.read.parquet(f"{s.path}/blocks").filter(F.col("term") != ROWS).withColumn("segment", F.lit(i)) for i, s in enumerate(index.segments) if not s.dead]
    return reduce(DataFrame.unionByName, parts)


def _alive(blocks: DataFrame, dead: DataFrame | None) -> DataFrame:
    """Blocks with their postings that are alive as structs (x: key, tf, length), in place of the arrays."""
    each = F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
    if dead is None:
        return blocks.withColumn("x", each).drop("keys", "tfs", "lengths")
    left = F.when(F.col("gone").isNull(), each).otherwise(F.filter(each, lambda p: ~F.array_contains("gone", p["key"])))
    return blocks.join(dead, ["segment", "band"], "left").withColumn("x", left).drop("keys", "tfs", "lengths", "gone")


def _laid(blocks: DataFrame, dead: DataFrame | None, *more: str) -> DataFrame:
    """Postings of blocks that are alive: term, key, tf, length."""
    rows = _alive(blocks, dead).select("term", "segment", *more, F.explode_outer("x").alias("x"))
    return rows.filter("x is not null").select("term", "segment", *more, "x.key", "x.tf", "x.length")


def live_postings(spark: SparkSession, index: Index) -> DataFrame:
    """term, key, tf and length of all rows that are alive."""
    return _laid(_blocks(spark, index), _dead(spark, index)).select("term", F.col("key").alias(index.key), "tf", "length")


def merge(spark: SparkSession, index: Index) -> Index:
    """One segment in place of all: the postings that are alive, in bands of their own.

    Blocks and lost keys are dealt out by lanes, some bands of a level.  A block goes to one
    lane as it is, but for those of a segment with so few rows that its bands lie in several.
    """
    ship(spark)
    path = f"{index.root.rstrip('/')}/segment-{uuid.uuid4().hex}"
    levels = {}
    for s in index.segments:
        levels = {x: levels.get(x, 0) + s.levels.get(x, 0) for x in {*levels, *s.levels}}
    levels = {x: levels[x] for x in sorted(levels, key=int) if levels[x] > 0}
    deal = _deal(levels)
    most = {x: max(s.deal.get(x, 1) for s in index.segments) for x in {x for s in index.segments for x in s.deal}}
    lanes = {x: max(1, n // LANE, deal.get(x, 1) // LANE) for x, n in most.items()}
    deal = {x: max(n, lanes[x]) for x, n in deal.items()}  # a level that lost most of its rows shrinks by LANE in a merge, for the lost ones come along
    level, held = F.shiftright("band", 32).cast("int"), 0
    moved = []
    for i, s in enumerate(index.segments):
        if s.dead:
            continue
        stored = spark.read.parquet(f"{s.path}/blocks")
        held += stored.agg(F.sum("n")).first()[0] or 0
        told = stored.select(F.lit(i).alias("segment"), level.alias("level"), "band", "term", "keys", "tfs", "lengths")
        wide = [int(x) for x, n in lanes.items() if s.deal.get(x, 1) < n]
        part = F.col("band").bitwiseAND(F.lit((1 << 32) - 1))
        whole = told.filter(~F.col("level").isin(wide)).withColumn("lane", level.cast("bigint") * (1 << 32) + F.pmod(part, _parts_of(F.col("level"), lanes)))
        moved.append(whole.drop("band"))
        if wide:
            moved.append(_cut(told.filter(F.col("level").isin(wide)), lanes))
    for i, _, d in _losses(index):
        lost = spark.read.parquet(f"{d.path}/deaths").filter("length > 0").select(F.lit(i).alias("segment"), "level", "key", _band(F.col("key"), F.col("level"), lanes).alias("lane"))
        moved.append(lost.groupBy("segment", "level", "lane").agg(F.collect_set("key").alias("keys")).select("*", F.lit(None).cast("string").alias("term"), *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("tfs", "double"), ("lengths", "bigint"))]))
    told = reduce(DataFrame.unionByName, moved)
    key_type = told.schema["keys"].dataType.elementType.simpleString()
    of_rows = lambda c: F.when(F.col("term") == ROWS, c).otherwise(F.array().cast("array<bigint>"))  # noqa: E731  (many null arrays are slow to send to Python)
    hashes = F.transform("keys", lambda k: F.xxhash64(k))
    each = told.select("lane", "segment", "level", "term", "keys", "tfs", of_rows(F.col("lengths")).alias("lengths"), of_rows(hashes).alias("hashes"))
    dealt = each.mapInArrow(posting_blocks.packed, "lane bigint, rows binary").repartition(parts(held), "lane")
    _write_blocks(dealt.mapInArrow(posting_blocks.of_blocks({int(x): n for x, n in deal.items()}), posting_blocks.schema(key_type)), path)
    whole = Segment(path, False, *(sum(getattr(s, x) for s in index.segments) for x in ("rows", "held", "tokens")), levels, deal)
    return _publish(spark, replace(index, segments=(whole,)))


def _cut(blocks: DataFrame, lanes: dict[str, int]) -> DataFrame:
    """Blocks (level, band, keys, tfs, lengths and more) cut by the lanes of their rows."""
    parts = F.transform("keys", lambda k: F.pmod(F.xxhash64(k), F.col("parts")))
    told = blocks.withColumn("parts", _parts_of(F.col("level"), lanes)).withColumn("part", parts)
    each = told.select("*", F.explode(F.array_distinct("part")).alias("own"))
    of = lambda c: F.filter(c, lambda _, i: F.get("part", i) == F.col("own")).alias(c)
    return each.select("segment", "level", "term", *map(of, ("keys", "tfs", "lengths")), (F.col("level").cast("bigint") * (1 << 32) + F.col("own")).alias("lane"))


def frequencies(spark: SparkSession, index: Index) -> DataFrame:
    """term and df over all segments; terms that no row holds any more are left out."""
    told = lambda s: spark.read.parquet(f"{s.path}/terms") if s.dead else spark.read.parquet(f"{s.path}/blocks").filter(F.col("term") != ROWS).select("term", F.col("n").alias("df"))
    parts = [told(s) for s in index.segments]
    return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def _gain(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(float(average or 1.0))))


def top(spark: SparkSession, index: Index, terms: DataFrame, by: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(``by``, key, score, rank) of the k best rows of every query, and (``by``, blocks, read) of what that took.

    ``terms`` has ``by`` and term; repeated terms count again.  Rows without any of the
    terms are not found.
    """
    counted = terms.select(by, "term").filter("term is not null").groupBy(by, "term").agg(F.count(F.lit(1)).alias("times"))
    listed = counted.limit(MAX_TERMS + 1).collect()
    few = len(listed) <= MAX_TERMS
    asked = spark.createDataFrame(listed, counted.schema) if few else materialize(counted, "asked")
    names = sorted({r.term for r in listed})
    of_terms = lambda df: df.filter(F.col("term").isin(names)) if few else df.join(bounded_broadcast(asked.select("term").distinct()), "term", "left_semi")
    idf = F.greatest(F.log((F.lit(index.rows) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    weighed = asked.join(of_terms(frequencies(spark, index)), "term").select(by, "term", (F.col("times") * idf).alias("weight"))
    weighed = F.broadcast(spark.createDataFrame(weighed.collect(), weighed.schema)) if few else bounded_broadcast(materialize(weighed, "weights"))
    stored, dead = of_terms(_blocks(spark, index)), _dead(spark, index)
    score = F.sum(F.col("weight") * _gain(F.col("tf"), F.col("length"), index.average))
    best = Window.partitionBy(by).orderBy(F.desc("score"), "key")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k)  # noqa: E731  (limited in each task before it is shuffled)

    if not few:  # a task has some bands, and scores each of their rows for every query
        held, queries = stored.agg(F.sum("n")).first()[0], asked.select(by).distinct().count()
        dealt = stored.repartition(max(parts(held), parts(index.rows * queries)), "band")
        each = _laid(dealt.join(weighed, "term"), dead, by, "band", "weight")
        full = each.groupBy(by, "segment", "band", "key").agg(F.round(score, DIGITS).alias("score")).select(by, "key", "score")
        blocks = stored.select("term").join(weighed, "term").groupBy(by).agg(F.count(F.lit(1)).alias("blocks"))
        return ranked(full).withColumnRenamed("key", index.key), blocks.withColumn("read", F.col("blocks"))

    # Heads: the blocks of each query with their bounds, those of a band in falling order, and what they and the later ones can add.
    place = [by, "segment", "band"]
    bound = F.col("weight") * _gain(F.col("max_tf"), F.col("min_length"), index.average)
    heads = materialize(stored.select("term", "segment", "band", "n", "max_tf", "min_length").join(weighed, "term").select(*place, "term", "n", "weight", bound.alias("bound")), "heads")

    def postings_of(chosen: DataFrame) -> DataFrame:
        """Postings of chosen blocks (place, term, weight and more)."""
        return _laid(stored.join(chosen, ["segment", "band", "term"]), dead, by, "band", *[c for c in chosen.columns if c not in (*place, "term")])

    # The score to reach: the k-th best of the bands with the highest bounds.
    upto = Window.partitionBy(by).orderBy(F.desc("bound"), "segment", "band").rowsBetween(Window.unboundedPreceding, -1)
    bands = heads.groupBy(*place).agg(F.max("n").alias("most"), F.sum("bound").alias("bound"))
    first = bands.withColumn("held", F.coalesce(F.sum("most").over(upto), F.lit(0))).filter(F.col("held") < PROBE * k).select(*place)
    probe = stored.join(first, ["segment", "band"]).join(weighed, [by, "term"])
    probed = ranked(_laid(probe, dead, by, "weight").groupBy(by, "key").agg(F.round(score, DIGITS).alias("score")))
    least = materialize(probed.filter(F.col("rank") == k).select(by, (F.col("score") - 10.0**-DIGITS).alias("least")), "least")

    # A row that has none of the blocks before can reach what this one and the later ones add: if that is too little, the block makes no candidates.
    later, whole = Window.partitionBy(*place).orderBy(F.desc("bound"), "term"), Window.partitionBy(*place)
    left = heads.withColumn("rest", F.sum("bound").over(later.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    left = left.join(least, by, "left").withColumn("makes", F.col("least").isNull() | (F.col("rest") >= F.col("least")))
    left = left.withColumn("beyond", F.coalesce(F.max(F.when(~F.col("makes"), F.col("rest"))).over(whole), F.lit(0.0)))
    makers = left.filter("makes").select(*place, "term", "weight", "beyond", "least")
    partial = postings_of(makers).groupBy(*place, "key").agg(score.alias("part"), F.first("beyond").alias("beyond"), F.first("least").alias("least"))
    kept = materialize(partial.filter(F.col("least").isNull() | (F.col("part") + F.col("beyond") >= F.col("least"))).select(*place, "key", "part"), "candidates")

    lookups = left.filter("not makes").join(kept.select(*place).distinct(), place, "left_semi").select(*place, "term", "weight")
    added = postings_of(lookups).join(kept.select(*place, "key"), [*place, "key"], "left_semi").groupBy(*place, "key").agg(score.alias("added"))
    full = kept.join(added, [*place, "key"], "left").select(by, "key", F.round(F.col("part") + F.coalesce("added", F.lit(0.0)), DIGITS).alias("score"))

    read = makers.select(*place, "term").unionByName(lookups.select(*place, "term")).unionByName(heads.join(first, place, "left_semi").select(*place, "term")).distinct()
    report = heads.groupBy(by).agg(F.count(F.lit(1)).alias("blocks")).join(read.groupBy(by).agg(F.count(F.lit(1)).alias("read")), by)
    return ranked(full).withColumnRenamed("key", index.key), report
