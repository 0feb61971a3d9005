"""MinHash near duplicates by an inverted join over signature coordinates.

1. Each text gives its set of hashed 5-word shingles, a hash of the set, and a MinHash
   signature of COORDS coordinates.  Equal sets are one node from here on.
2. Every coordinate-value pair of a signature is a posting.  Pairs held by one node are
   dropped; the others are counted.  Two nodes that agree in at least MATCHES coordinates
   agree in one of any COORDS - MATCHES + 1 of them, so each node posts only that many,
   its rarest (those held by nobody else come first and need no posting).
3. In each posting list, every node is compared with the list's central node only: the
   collisions are counted over the full signatures, pairs below MATCHES are skipped, the
   rest is confirmed on the full sets.  The number of pairs follows the postings, however
   long a list is.
4. The lists of one central node are a group.  Groups whose nodes are not in one component
   after that are merged once more, for their pairs between different components.  That
   happens inside tasks, over blocks of at most BLOCK_NODES nodes, and no pair leaves a
   task but the links that join two components there (fewer than it has nodes).  For each
   node the merge skips partners in three steps: by size and by what each has alone; by
   collisions, a quarter of the coordinates at a time, once those so far and those left
   cannot reach MATCHES; and by component, as soon as an earlier link joined them.  What
   is left is confirmed on the full sets.

Before 3 and 4, the shingles that a set alone holds are counted.  They bound every
similarity of that set from above, so edited copies that are too far from all others
leave the lists, and pairs that cannot be similar enough are skipped.

So no link between different components is lost but by the signature threshold: at the
default similarity of 0.85, MATCHES lies five standard deviations below the mean.

Defined results: texts without words (null ones too) have an empty set and are linked
with nothing; texts of fewer than five words have one shingle; all texts of one doc_id
are linked with each other; rows with a null doc_id are linked with nothing and have no
component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.llm.memory import give_back
from traceframe.operators.graph import connected_components
from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import bounded_broadcast

WORDS, COORDS = 5, 64
#: Similarity in hundredths, and the coordinates that a pair has to share to be confirmed.
SIMILARITY, MATCHES = 85, 40
#: Nodes, and shingles of all of them, of one block (about); a task merges two blocks.
BLOCK_NODES, BLOCK_SHINGLES = 1_024, 1 << 20


def matches_for(similarity: int, coords: int = COORDS) -> int:
    """Coordinates that all but about one pair in a million at this similarity share."""
    p = similarity / 100
    return max(1, int(coords * p - 5 * (coords * p * (1 - p)) ** 0.5))


_A = (np.random.default_rng(20240229).integers(1, 2**62, COORDS, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = np.random.default_rng(20240301).integers(0, 2**63, COORDS, np.uint64)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles; A-Z count as a-z, ASCII blanks part words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    mixed = np.zeros(len(h) - words + 1, np.uint64)
    for d in range(words):
        mixed = (mixed ^ h[d : len(h) - words + 1 + d]) * _M[d % len(_M)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """Smallest value of each of the hash functions, upper half."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), 4096):
        low = np.minimum(low, (found[lo : lo + 4096, None] * _A + _B).min(0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketch(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, set_hash and sig of every row; sig is null without shingles."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                 pa.array([signature(s).tolist() if len(s) else None for s in sets], pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "set_hash", "sig"],
            )
        give_back()

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(sketched, "doc_id bigint, n_shingles bigint, set_hash binary, sig array<int>")


def postings(nodes: DataFrame, matches: int) -> DataFrame:
    """node and coordinate-value pair, for each node's COORDS - matches + 1 rarest pairs that others hold too."""
    place = F.transform("sig", lambda v, i: F.xxhash64(i, v))
    every = nodes.select("node", F.explode_outer(place).alias("pair"))
    held = every.groupBy("pair").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1")
    shared = every.join(held, "pair").select("node", "pair", "nodes")
    by_node = Window.partitionBy("node")
    ranked = shared.withColumn("unshared", COORDS - F.count(F.lit(1)).over(by_node)).withColumn("rank", F.row_number().over(by_node.orderBy("nodes", "pair")))
    return ranked.filter(F.col("rank") + F.col("unshared") <= COORDS - matches + 1).select("node", "pair")


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, similarity: int) -> DataFrame:
    """Those of the pairs (a, b) that collide often enough and whose full sets are similar enough."""
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    hits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    near = both.filter(hits >= matches).select("a", "b")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                keep.append(similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), similarity))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return full.select("a", "b", "ga", "gb").mapInArrow(compared, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, nodes: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and the full set of its text, for the nodes given (node, doc, set_hash; a stored table); stored.

    Rows that are repeated as a whole give a set each, of which one is kept.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words).tobytes() for t in batch.column(2).to_pylist()]
            own = [xxhash.xxh3_128_digest(g) == h for g, h in zip(found, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "grams"]).filter(pa.array(own, pa.bool_()))
        give_back()

    own = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    texts = own.join(bounded_broadcast(nodes), "doc").select("node", "set_hash", "text")
    sets = materialize(texts.mapInArrow(hashed, "node bigint, grams binary"), "sets")
    return sets if sets.count() == nodes.count() else materialize(sets.groupBy("node").agg(F.first("grams").alias("grams")), "sets")


def linkable(sets: DataFrame, similarity: int) -> DataFrame:
    """node, n (size of its set) and own (shingles that no other set holds) of the nodes that a link is possible for."""

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                grams = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)[lo : lo + 500]]
                node = np.repeat(batch.column(0)[lo : lo + 500].to_numpy(), [len(g) for g in grams])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(grams))], names=["node", "gram"])
        give_back()

    every = sets.mapInArrow(laid_out, "node bigint, gram bigint")
    alone = every.groupBy("gram").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("held")).filter("held = 1")
    own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("node", (F.length("grams") / 8).cast("bigint").alias("n")).join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))
    return sized.filter(100 * (F.col("n") - F.col("own")) >= similarity * F.col("n"))


def _may_link(similarity: int, na, oa, nb, ob, least, greatest):  # columns or arrays alike  # noqa: ANN001, ANN202
    """Can two sets be similar enough, by their sizes and what each has alone?

    The intersection has nothing that one has alone, and the union has all of it.
    """
    return 100 * least(na - oa, nb - ob) >= similarity * greatest(na + ob, nb + oa)


class _Forest:
    """Components that a task has seen joined."""

    def __init__(self, labels: np.ndarray):
        self.root = np.unique(labels, return_inverse=True)[1]  # of each row

    def join(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]


def merge_block(
    node: np.ndarray, component: np.ndarray, n: np.ndarray, own: np.ndarray, sig: np.ndarray, grams: list[np.ndarray], side: np.ndarray, matches: int, similarity: int
) -> list[tuple[int, int]]:
    """Links that join different components among the rows of a block, or of two (then only across ``side``)."""
    order = np.argsort(n, kind="stable")
    node, component, n, own, sig, side = node[order], component[order], n[order], own[order], sig[order], side[order]
    grams = [grams[i] for i in order]
    across, forest, out = len(np.unique(side)) > 1, _Forest(component), []
    step = COORDS // 4
    for i in range(len(node) - 1):
        last = int(np.searchsorted(n, n[i] * 100 // similarity, "right"))
        j = np.arange(i + 1, max(last, i + 1))
        keep = (forest.root[j] != forest.root[i]) & _may_link(similarity, n[i], own[i], n[j], own[j], np.minimum, np.maximum)
        if across:
            keep &= side[j] != side[i]
        j = j[keep]
        hits = np.zeros(len(j), np.int64)
        for lo in range(0, COORDS, step):
            hits = hits + (sig[j, lo : lo + step] == sig[i, lo : lo + step]).sum(1)
            left = hits + (COORDS - lo - step) >= matches
            j, hits = j[left], hits[left]
        for k in j[np.argsort(-hits, kind="stable")]:
            if forest.root[k] != forest.root[i] and similar(grams[i], grams[k], similarity):
                out.append((int(node[i]), int(node[k])))
                forest.join(i, k)
    return out


def similar(p: np.ndarray, q: np.ndarray, similarity: int) -> bool:
    """Are two ascending sets similar enough?"""
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    common = int((q[at] == p).sum())
    return 100 * common >= similarity * (len(p) + len(q) - common)


def merge_groups(groups: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, similarity: int) -> DataFrame:
    """Links (a, b) that join different components within a group.

    ``groups`` has first (the group), node, n, own, component and main (is it the component
    of the group's central node, which needs no comparison within itself).  Blocks are
    dealt by a hash within both parts; a row goes to one task for each block that its own
    block has to meet.
    """
    sizes = groups.groupBy("first").agg(
        *[F.coalesce(F.greatest(F.ceil(F.sum(F.when(who, 1)) / BLOCK_NODES), F.ceil(F.sum(F.when(who, F.col("n"))) / BLOCK_SHINGLES)), F.lit(0)).cast("int").alias(name) for name, who in (("mains", F.col("main")), ("others", ~F.col("main")))],
        (F.count(F.lit(1)) <= BLOCK_NODES).alias("few"), (F.sum("n") <= BLOCK_SHINGLES).alias("small"),
    )
    dealt = groups.join(sizes, "first")
    block = F.when(F.col("main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    one = F.col("few") & F.col("small")
    last = F.col("mains") + F.col("others") - 1
    meets = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.when(F.col("main"), F.col("mains")).otherwise(0), last))
    tasks = dealt.withColumn("block", F.when(one, 0).otherwise(block)).withColumn("other", F.explode(meets))
    tasks = tasks.select("first", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "own", "component")
    full = tasks.join(nodes.select("node", "sig"), "node").join(sets, "node")

    def merged(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).to_numpy()
        sig = np.array(rows.column("sig").combine_chunks().flatten()).reshape(-1, COORDS)
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("grams")]
        found = merge_block(column("node"), column("component"), column("n"), column("own"), sig, grams, column("block"), matches, similarity)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return full.groupBy("first", "i", "j").applyInArrow(merged, "a bigint, b bigint")


def find_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    matches = matches_for(similarity)
    own = materialize(sketch(docs, id_col=id_col, text_col=text_col, words=words), "sketches")
    linked = own.filter("n_shingles > 0 and doc_id is not null")
    distinct = linked.groupBy("set_hash").agg(F.min("doc_id").alias("doc"), F.min_by("sig", "doc_id").alias("sig"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so the numbers stay
    posted = materialize(postings(nodes, matches), "postings")
    asked = materialize(nodes.join(posted.select("node").distinct(), "node").select("node", "doc", "set_hash"), "posted")
    sets = shingle_sets(docs, asked, id_col=id_col, text_col=text_col, words=words)
    posted = materialize(posted.join(linkable(sets, similarity), "node"), "linkable")

    least = F.min(F.struct("own", "node", "n"))  # the one with least of its own: in a group of edited copies, the text they come from
    lists = posted.groupBy("pair").agg(least.alias("f"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("pair", F.col("f.node").alias("first"), F.col("f.n").alias("nf"), F.col("f.own").alias("of"))
    led = materialize(posted.join(lists, "pair").select("first", "nf", "of", "node", "n", "own").distinct(), "led")
    possible = _may_link(similarity, F.col("nf"), F.col("of"), F.col("n"), F.col("own"), F.least, F.greatest)
    to_first = led.filter((F.col("first") != F.col("node")) & possible).select(F.col("first").alias("a"), F.col("node").alias("b"))
    members = linked.select("set_hash", "doc_id").distinct().join(nodes.select("set_hash", "node"), "set_hash").select("doc_id", "node")
    shared_ids = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z")
    same_id = shared_ids.join(members, "doc_id").filter("a <> node").select("a", F.col("node").alias("b"))
    links = materialize(confirm(to_first, nodes, sets, matches, similarity).unionByName(same_id), "links")
    found = connected_components(links, "a", "b")

    # Only the central node is left out of its group, as it has met all others.
    placed = led.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = placed.filter("first = node").select("first", F.col("component").alias("central"))
    rest = materialize(placed.filter("first <> node").join(first, "first").withColumn("main", F.col("component") == F.col("central")), "rest")
    mixed = rest.groupBy("first").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("first")
    groups = materialize(rest.join(mixed, "first").select("first", "node", "n", "own", "component", "main"), "groups")
    if not groups.isEmpty():
        more = materialize(merge_groups(groups, nodes, sets, matches, similarity), "more_links")
        found = connected_components(links.unionByName(more), "a", "b")

    named = nodes.select("node", "doc").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.join(named.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("node", "component_id")
    by_doc = materialize(members.join(names, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "members")
    out = own.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES: dict[str, str] = {}
