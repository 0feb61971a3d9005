"""Embedding whitening from the covariance of the distinct vectors.

Entries become whole numbers, x = floor(scale * c), so that equal vectors are equal and
sums are exact.  The fit list holds each distinct x once: a vector that a third of the
rows share counts as one, and copies are collapsed before they are shuffled.

The covariance is one aggregation.  Dimensions are taken in blocks of BLOCK; a row of the
fit list stands once for each pair of blocks of the upper triangle, and the generated
expressions sum the BLOCK * BLOCK centred products of a pair.  So every pair of dimensions
is summed, the expressions stay few enough to be compiled however wide the vectors are,
and partial sums leave a task as one row for each pair of blocks.  The matrix, of a size
that the dimensions alone decide, is put together on the driver and decomposed by LAPACK.

Defined results: rows whose vector is null, or holds a null or a non-finite entry, take no
part; nor do vectors of another length than the commonest one (the shorter one, if two are
as common).  Repeated rows give repeated results, a null id stays null, other columns are
not read.  Components without variance (at most d * 2**-52 of the largest) cannot be
scaled: their ``whitened`` is null.  A ``deviation`` beyond a long is null.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize

#: Whole numbers are entries times this; dimensions of a block.
SCALE, BLOCK = 256, 8


@dataclass(frozen=True)
class Whitening:
    """``sums`` and ``low`` / ``high`` (extremes) by dimension, ``n`` distinct vectors, eigenvalues (falling) and their vectors as columns."""

    n: int
    sums: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def weights(self, k: int) -> np.ndarray | None:
        """What centred x is multiplied with for component k (from 0); None without variance."""
        floor = len(self.values) * 2.0**-52 * max(float(self.values[0]), 0.0)
        return None if self.values[k] <= floor else self.vectors[:, k] / np.sqrt(self.values[k])


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id and x of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.filter(F.col(vector_col).isNotNull()).filter(F.coalesce(good, F.lit(False)))
    own = own.select(F.col(id_col).alias("id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    common = own.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return own.filter(F.size("x") == (common.d if common else 0))


def _sum(terms: list[Column]) -> Column:
    """A balanced sum, so that wide vectors do not nest deeply."""
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def covariance(fit_list: DataFrame, means: list[float], n: int, block: int = BLOCK) -> np.ndarray:
    """Covariance (divisor n) of the columns of array x, centred before they are multiplied."""
    d = len(means)
    blocks = -(-d // block)
    pairs = [(i, j) for i in range(blocks) for j in range(i, blocks)]
    centre = _doubles([*means, *[0.0] * (blocks * block - d)])
    spread = fit_list.select("x", F.explode(F.array(*[F.lit(i * blocks + j) for i, j in pairs])).alias("pair"))
    spread = spread.select("x", "pair", F.floor(F.col("pair") / blocks).cast("int").alias("i"), (F.col("pair") % blocks).alias("j"))

    def entry(of: str, p: int) -> Column:
        at = F.col(of) * block + p
        return (F.coalesce(F.get("x", at), F.lit(0)).cast("double") - F.get(centre, at)).alias(f"{of}{p}")

    centred = spread.select("pair", *[entry("i", p) for p in range(block)], *[entry("j", p) for p in range(block)])
    products = [F.expr(f"sum(i{p} * j{q})").alias(f"s{p}_{q}") for p in range(block) for q in range(block)]
    matrix = np.zeros((blocks * block, blocks * block))
    for row in centred.groupBy("pair").agg(*products).collect():  # one row for each pair of blocks
        i, j = divmod(row.pair, blocks)
        part = np.array(row[1:], float).reshape(block, block) / n
        matrix[i * block : (i + 1) * block, j * block : (j + 1) * block] = part
    upper = np.triu(matrix[:d, :d])
    return upper + np.triu(upper, 1).T


def fit(fit_list: DataFrame) -> Whitening | None:
    """Sums, covariance and its decomposition; None for an empty list or vectors without entries."""
    told = fit_list.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c").cast("decimal(19,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high")
    )
    rows = sorted(told.collect())  # one row for each dimension
    if not rows:
        return None
    n, sums = rows[0].n, tuple(int(r.s) for r in rows)
    values, vectors = np.linalg.eigh(covariance(fit_list, [s / n for s in sums], n))
    return Whitening(n, sums, tuple(r.low for r in rows), tuple(r.high for r in rows), values[::-1], vectors[:, ::-1])


def _deviation(model: Whitening) -> Column:
    """Sum of (n * x - S) ** 2, exact: in longs where the extremes of each dimension prove that they suffice, else in decimals of 38 digits."""
    n = model.n
    most = sum(max((n * v - s) ** 2 for v in (a, b)) for a, b, s in zip(model.low, model.high, model.sums, strict=True))
    reach = max(abs(v) for v in (*model.low, *model.high)) * n
    kind = "bigint" if max(most, reach) < 1 << 63 else "decimal(38,0)"
    sums = F.array(*[F.lit(str(s)).cast(kind) for s in model.sums])
    off = F.zip_with("x", sums, lambda v, s: F.try_subtract(F.try_multiply(v.cast(kind), F.lit(str(n)).cast(kind)), s))
    total = F.aggregate(off, F.lit("0").cast(kind), lambda a, v: F.try_add(a, F.try_multiply(v, v)).cast(kind))
    return total if kind == "bigint" else total.try_cast("bigint")


def projected(model: Whitening, k: int) -> Column:
    """Whitened value of x on component k (from 0)."""
    w = model.weights(k)
    if w is None:
        return F.lit(None).cast("double")
    return _sum([(F.get("x", i).cast("double") - F.lit(m)) * F.lit(float(c)) for i, (m, c) in enumerate(zip(model.means, w, strict=True))])


def identity_error(fit_list: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity; one pass over the list."""
    known = [k for k in range(components) if model.weights(k) is not None]
    if not known:
        return None
    z = fit_list.select(*[projected(model, k).alias(f"z{k}") for k in known])
    pairs = [(a, b) for a in known for b in known if a <= b]
    row = z.agg(*[(F.sum(F.col(f"z{a}") * F.col(f"z{b}")) / model.n).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(
    vectors: DataFrame, *, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
    keep: Callable[[DataFrame], DataFrame] = lambda df: materialize(df, "fit"),
) -> DataFrame:
    """One row for each vector and component: id, component (from 1), n, deviation, whitened, explained, eigenvalue, identity_error.

    ``keep`` stores the fit list, which is read three times.
    """
    own = whole(vectors, id_col, vector_col, scale)
    fit_list = keep(own.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"))
    model = fit(fit_list)
    some = min(components, len(model.values)) if model else 0
    schema = "component int, explained double, eigenvalue double, whitened double"
    if not some:
        nothing = own.filter(F.lit(False)).select("id", F.lit(0).alias("component"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "eigenvalue", "identity_error")])
        return nothing.withColumnRenamed("id", id_col)
    trace = float(model.values.sum())
    parts = [
        F.struct(F.lit(k + 1).alias("component"), F.lit(float(model.values[k]) / trace if trace > 0 else None).cast("double").alias("explained"), F.lit(float(model.values[k])).alias("eigenvalue"), projected(model, k).alias("whitened"))
        for k in range(some)
    ]
    error = F.lit(identity_error(fit_list, model, some)).cast("double")
    told = own.select("id", _deviation(model).alias("deviation"), F.array(*parts).cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").alias("parts"))
    laid = told.select("id", "deviation", F.inline("parts"))
    return laid.select(F.col("id").alias(id_col), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", "explained", "eigenvalue", error.alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
