"""Approximate nearest neighbours with an inverted multi-index.

Fitting.  Each half of the vectors is quantised by its own k-means, on a bounded sample;
a cell is a pair of centroids, and the centroids of a half grow with the square root of
the table, so that a cell holds about PER_CELL vectors.  Indexing.  Every distinct
vector is filed under its cell, with the ids that have it.  Searching.  For a query the
distance of a centroid is minus its inner product with the query's half; a heap walks
the centroid pairs by the sum of the two distances until the cells seen hold the share
of all vectors that the wanted recall takes.  That share is measured on the sample, for
the rank there that the k-th neighbour in the whole table has; it is small for clustered
vectors, and about half for vectors without any structure.
Reranking.  Cells are put together to blocks of about BLOCK vectors, near ones together,
and a row is sent once to its block: a vector to the block of its cell, a query to the
blocks that hold a cell it visits.  A task sorts vectors before queries and streams the
queries past the block: it scores the visited cells only, in double precision, and keeps
the best of each query.  The best of all blocks are returned.

A hot cell is split by a hash of its vectors.  Equal vectors are one entry with their
smallest ids: no more of them can be among the results, so a vector that a third of the
rows share costs one.

Defined results: vectors that are null, of another length than the most common one among
those searched, zero, or with null or non-finite components take no part; ties go to the
smaller id; of several vectors with one id the smallest counts; with fewer candidates
than wanted all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize

#: Vectors to fit on (about; at most twice as many), vectors of a cell (about), centroids of each half at most, rounds of k-means.
SAMPLE, PER_CELL, CENTROIDS, ROUNDS = 20_000, 64, 256, 12
#: Share of the nearest neighbours in the sample that has to be met, and queries that are tried for it.
RECALL, TRIED = 0.97, 256
#: Vectors of a block (about), and queries scored at once.
BLOCK, AT_ONCE = 8_192, 256


def usable(vectors: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> DataFrame:
    """id and double vector of the rows that take part; ``size`` is their length, by default the commonest one."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(F.coalesce(good, F.lit(False)))
    own = own.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    if size is None:
        common = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = common.n if common else 0
    return own.filter(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


def fit(entries: DataFrame, total: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sample, about SAMPLE of the ``total`` distinct vectors chosen by a hash, and the centroids of both halves."""
    part = int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30))
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    rows = entries.select("v", draw.alias("draw")).filter(F.col("draw") < part).limit(2 * SAMPLE).collect()
    x = np.array([r.v for r in sorted(rows, key=lambda r: (r.draw, r.v))], float)
    if not len(x):
        return np.zeros((0, 0)), [np.zeros((1, 0)), np.zeros((1, 0))]
    half, rng = x.shape[1] // 2, np.random.default_rng(7)
    k = int(np.clip(round((total / PER_CELL) ** 0.5), 1, min(CENTROIDS, max(1, len(x) // 4))))
    return x, [_kmeans(x[:, :half], k, rng), _kmeans(x[:, half:], k, rng)]


def wanted_share(x: np.ndarray, centers: list[np.ndarray], k: int, total: int) -> float:
    """Share of all vectors to visit so that RECALL of the k nearest are met, as tried on the sample."""
    if len(x) < 2:
        return 1.0
    half, wide = centers[0].shape[1], len(centers[1])
    cell = _nearest(x[:, :half], centers[0]) * wide + _nearest(x[:, half:], centers[1])
    sizes = np.bincount(cell, minlength=len(centers[0]) * wide)
    near = int(np.clip(round(k * len(x) / total), 1, len(x) - 1))
    shares = []
    for t in range(min(TRIED, len(x))):  # the sample is in the order of a hash
        score = x @ x[t]
        score[t] = -np.inf
        best = np.argpartition(-score, near - 1)[:near]
        order = np.argsort((-(centers[0] @ x[t, :half])[:, None] - (centers[1] @ x[t, half:])[None, :]).ravel(), kind="stable")
        seen = np.empty(len(order))
        seen[order] = np.cumsum(sizes[order])
        shares.append(seen[cell[best]] / len(x))
    return float(np.quantile(np.concatenate(shares), RECALL, method="higher"))


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) in ascending order of first[i] + second[j], by a heap over the sorted halves.

    >>> list(walk(np.array([0.0, 3.0]), np.array([1.0, 0.0])))
    [(0, 1), (0, 0), (1, 1), (1, 0)]
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, met = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in met:
                met.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))


def regions(centers: np.ndarray, sizes: np.ndarray, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Region of each centroid of the first half, and the blocks that each region is split into.

    Centroids are taken in the order of their main direction, until a region is full.
    """
    around = centers - centers.mean(0)
    along = around @ np.linalg.svd(around, full_matrices=False)[2][0] if around.size else np.zeros(len(centers))
    place, held = np.zeros(len(centers), np.int64), [0]
    for i in np.argsort(along, kind="stable"):
        if held[-1] and held[-1] + sizes[i] > most:
            held.append(0)
        place[i] = len(held) - 1
        held[-1] += int(sizes[i])
    return place, np.maximum(1, -(-np.array(held) // most))


class _Block:
    """Vectors of one block, in the order of their cells."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        self.x = _matrix(rows.column("v").to_pylist())
        self.cells, self.first = np.unique(rows.column("cell").to_numpy(), return_index=True)
        self.last = np.append(self.first[1:], len(self.x))
        ids = rows.column("ids").combine_chunks()
        self.ids, self.copies = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
        self.begin = np.cumsum(self.copies) - self.copies
        self.longest = float(np.sqrt((self.x**2).sum(1).max()))

    def best(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """query_id, vec_id and score of the k best of each query, the query itself left out."""
        names, q = asked.column(asked.schema.get_field_index("query")).to_numpy(), _matrix(asked.column(asked.schema.get_field_index("v")).to_pylist())
        lists = asked.column(asked.schema.get_field_index("cells"))
        visited = np.zeros((len(q), len(self.cells)), bool)
        at = np.searchsorted(self.cells, flat := lists.flatten().to_numpy())
        here = (at < len(self.cells)) & (self.cells[np.minimum(at, len(self.cells) - 1)] == flat)
        visited[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))[here], at[here]] = True
        rough = np.full((len(q), len(self.x)), -np.inf)
        for c, (lo, hi) in enumerate(zip(self.first, self.last, strict=True)):
            who = np.flatnonzero(visited[:, c])
            rough[who, lo:hi] = q[who] @ self.x[lo:hi].T
        few = min(rough.shape[1], k + 1)
        close = 1e-12 * self.longest * np.sqrt((q**2).sum(1))  # what rounding may have parted stays in
        cut = -np.partition(-rough, few - 1, axis=1)[:, few - 1] - close
        i, j = np.nonzero((rough >= cut[:, None]) & (rough > -np.inf))
        score, n = (q[i] * self.x[j]).sum(1), self.copies[j]
        ids = self.ids[np.repeat(self.begin[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        i, score = np.repeat(i, n), np.repeat(score, n)
        other = ids != names[i]
        i, score, ids = i[other], score[other], ids[other]
        order = np.lexsort((ids, -score, i))
        i, score, ids = i[order], score[order], ids[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
        return pa.RecordBatch.from_arrays([pa.array(names[i][keep]), pa.array(ids[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest by inner product, itself left out."""
    own = materialize(usable(vectors, id_col, vector_col), "vectors")
    size = own.select(F.size("v").alias("n")).first()
    asked = usable(queries, id_col, vector_col, size.n if size else 0)

    # One entry for each distinct vector, with the k + 1 smallest ids that have it.
    same = Window.partitionBy("v").orderBy("id")
    entries = own.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = materialize(entries, "entries")
    total = entries.count()
    sample, centers = fit(entries, total)
    half, wide = centers[0].shape[1], len(centers[1])

    def filing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), float)
                cell = _nearest(x[:, :half], centers[0]) * wide + _nearest(x[:, half:], centers[1])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1)], names=["cell", "v", "ids"])

    filed = materialize(entries.select("v", "ids").mapInArrow(filing, "cell int, v binary, ids array<bigint>"), "index")
    sizes = np.zeros(len(centers[0]) * wide, np.int64)
    for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most CENTROIDS ** 2 rows
        sizes[r.cell] = r.n
    enough = max(k + 1, int(np.ceil(wanted_share(sample, centers, k, max(total, 1)) * total)))
    place, blocks = regions(centers[0], sizes.reshape(len(centers[0]), wide).sum(1))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y, seen, held = np.array(v, float), 0, {}
                for i, j in walk(-(centers[0] @ y[:half]), -(centers[1] @ y[half:])):
                    if n := int(sizes[cell := i * wide + j]):
                        held.setdefault(int(place[i]), []).append(cell)
                        seen += n
                        if seen >= enough:
                            break
                out += [((region << 32) + b, query, y.tobytes(), cells) for region, cells in held.items() for b in range(int(blocks[region]))]
            if out:
                keys, names, vs, cells = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(vs, pa.binary()), pa.array(cells, pa.list_(pa.int32()))], names=["block", "query", "v", "cells"])

    visits = asked.select("id", "v").mapInArrow(visiting, "block bigint, query bigint, v binary, cells array<int>")
    where = F.array(*[F.lit(int(p)) for p in place])
    split = F.array(*[F.lit(int(b)) for b in blocks])
    region = F.get(where, F.floor(F.col("cell") / wide).cast("int"))
    none = F.lit(None)
    left = visits.select("block", F.lit(1).alias("kind"), none.cast("int").alias("cell"), "v", none.cast("array<bigint>").alias("ids"), "query", "cells")
    right = filed.withColumn("region", region).select(
        (F.shiftleft(F.col("region").cast("bigint"), 32) + F.pmod(F.xxhash64("v"), F.get(split, F.col("region")))).alias("block"),
        F.lit(0).alias("kind"), "cell", "v", "ids", none.cast("bigint").alias("query"), none.cast("array<int>").alias("cells"),
    )

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    key, held, block = keys[lo], [], None
                if kinds[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held:
                    block = block or _Block(held)
                    for at in range(lo, hi, AT_ONCE):
                        yield block.best(batch.slice(at, min(AT_ONCE, hi - at)), k)

    dealt = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind", "cell")
    scored = dealt.mapInArrow(scoring, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


QUERIES = {"op4_ann": op4_ann}
ORACLES: dict[str, str] = {}
