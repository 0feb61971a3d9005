"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its distinct words (edges without punctuation, lower
case), and for each word shape and for immediate repetition the share of words that have
it, in steps of halves.  One weight vector is shared by all grades and ordered thresholds
cut the latent score: P(grade <= k) = sigmoid(threshold_k - w.x).  Features that do not
go with the grade in the sample (a z-score) get no weight, so long texts do not drift.

A shape is that of the whole word, and every feature that passes the screen has a weight.
The model is fitted on a bounded sample of labelled rows; everything else covers all rows.

Defined results: a null text or one without words has no feature and is rated by the
thresholds alone; repeated rows are rated once each; several labels of one id count as
the lowest; other columns are not read; without labels every text gets grade 0 and a
tail probability of 1, so nothing is rejected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm.memory import give_back

#: Labelled rows to learn from (about; at most twice as many), chosen by a hash of the id.
SAMPLE_ROWS = 8_000
BUCKETS, MIN_ROWS, MIN_Z = 1 << 18, 4, 3.5
#: Selected are texts whose probability of the highest grade is at least this.
MIN_TAIL = 0.5
STEPS, RATE, RIDGE = 400, 0.3, 0.05
#: Shares count as of so many words at least: one odd word of three says little.
SHORT = 12
CACHE_ENTRIES = 150_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_SHAPES = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(\W)\1+"), r"\1")]
_ODD = re.compile(r"[^\w.,;:!?'\"()/-]")
_memo: dict[str, tuple[int, str]] = {}


def _bucket(kind: str, what: str) -> int:
    return zlib.crc32(f"{kind}:{what}".encode("utf-8", "surrogatepass")) % BUCKETS


def _word(word: str) -> tuple[int, str]:
    """Bucket of the bare word, and the word's shape."""
    if (found := _memo.get(word)) is None:
        shape = word
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        found = _memo[word] = (_bucket("w", _EDGE.sub("", word).lower()), shape)
    return found


def features(text: str | None) -> np.ndarray:
    """Buckets of the whole text's features, ascending."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_memo) > CACHE_ENTRIES:
        _memo.clear()
    found, shapes = set(), Counter({"again": sum(map(eq, words, words[1:]))})
    for word, n in Counter(words).items():
        bucket, shape = _word(word)
        found.add(bucket)
        shapes["s" + shape] += n
        if _ODD.search(shape):
            shapes["odd"] += n
    for shape, n in shapes.items():
        step = 0
        while n and step <= 6 and (n << step) < max(len(words), SHORT):
            step += 1
        found.update(_bucket("s", f"{shape}/{k}") for k in range(step, 7) if n)
    return np.array(sorted(found), np.int64)


@dataclass(frozen=True)
class Model:
    """Weights by bucket, and the ordered thresholds between the grades 0, 1, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ...; a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray) -> Model:
    """Screen the features, then descend the cumulative-link likelihood's gradient (Adagrad)."""
    if not len(rows) or len(np.unique(grades)) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(0))
    top = int(grades.max())
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n = np.bincount(flat, minlength=BUCKETS)
    z = np.zeros(BUCKETS)
    for k in range(1, top + 1):  # does the share of rows at or above k differ where the feature is?
        high = grades >= k
        p, seen = high.mean(), np.bincount(flat, high[owner], minlength=BUCKETS)
        with np.errstate(invalid="ignore", divide="ignore"):
            z = np.maximum(z, np.nan_to_num(np.abs(seen - n * p) / np.sqrt(n * p * (1 - p))))
    kept = np.flatnonzero((n >= MIN_ROWS) & (z >= MIN_Z))
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    use = place[flat] >= 0
    column, owner = place[flat[use]], owner[use]
    w, cut, gap = np.zeros(len(kept)), 0.0, np.zeros(top - 1)
    sums = [np.full(len(kept), 1e-6), 1e-6, np.full(top - 1, 1e-6)]
    for _ in range(STEPS):
        _, grads = objective(w, cut, gap, column, owner, grades)
        for i, g in enumerate(grads):
            sums[i] = sums[i] + g * g
        w = w - RATE * grads[0] / np.sqrt(sums[0])
        cut = cut - RATE * grads[1] / np.sqrt(sums[1])
        gap = gap - RATE * grads[2] / np.sqrt(sums[2])
    weights = np.zeros(BUCKETS)
    weights[kept] = w
    return Model(weights, _ordered(cut, gap))


def _ordered(cut: float, gap: np.ndarray) -> np.ndarray:
    """Thresholds, each above the one before by exp(gap)."""
    return cut + np.concatenate([[0.0], np.cumsum(np.exp(gap))])


def objective(w: np.ndarray, cut: float, gap: np.ndarray, column: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> tuple[float, list]:
    """Mean negative log likelihood with a ridge, and its gradient by w, cut and gap.

    Row ``owner[i]`` has the feature ``column[i]``.
    """
    rows = len(grades)
    score = np.bincount(owner, w[column], minlength=rows)
    theta = np.concatenate([[-np.inf], _ordered(cut, gap), [np.inf]])
    low, high = _sigmoid(theta[grades] - score), _sigmoid(theta[grades + 1] - score)
    d_low, d_high = low * (1 - low), high * (1 - high)
    p = np.maximum(high - low, 1e-12)
    by_score = (d_high - d_low) / p / rows
    by_theta = np.zeros(len(theta))
    np.add.at(by_theta, grades + 1, -d_high / p / rows)
    np.add.at(by_theta, grades, d_low / p / rows)
    inner = by_theta[1:-1]
    loss = -np.log(p).mean() + RIDGE * (w**2).sum() / 2 / rows
    return float(loss), [np.bincount(column, by_score[owner], minlength=len(w)) + RIDGE * w / rows, inner.sum(), np.exp(gap) * np.cumsum(inner[:0:-1])[::-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train(docs: DataFrame, graded: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fit on about SAMPLE_ROWS of the rows of ``graded`` (id, grade >= 0) that have a document.

    The sample of labels is at most twice that, so it is broadcast to the documents.
    """
    own = graded.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id is not null and grade >= 0")
    part = int(min(1.0, SAMPLE_ROWS / max(own.count(), 1)) * (1 << 30))
    drawn = own.filter(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) < part).groupBy("id").agg(F.min("grade").alias("grade")).limit(2 * SAMPLE_ROWS)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["grade", "features"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id").select("grade", "text").mapInArrow(hashed, "grade int, features binary").collect()
    rows.sort(key=lambda r: (r.grade, bytes(r.features)))
    return fit([np.frombuffer(r.features, "<i4").astype(np.int64) for r in rows], np.array([r.grade for r in rows], np.int64))


def rate(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, expected_grade and p_top (probability of the highest grade) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([shared.value.weights[features(t)].sum() for t in batch.column(1).to_pylist()], float)
            tails = shared.value.tails(score)
            top = tails[:, -1] if tails.shape[1] else np.ones(len(score))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(top)], names=["id", "expected_grade", "p_top"])
        _memo.clear()  # an idle worker holds no memory for it
        give_back()

    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(rated, f"id {kind}, expected_grade double, p_top double").withColumnRenamed("id", id_col)


def select(docs: DataFrame, model: Model, *, text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of ``docs``, unchanged, whose probability of the highest grade is high enough."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([shared.value.weights[features(t)].sum() for t in batch.column(at).to_pylist()], float)
            tails = shared.value.tails(score)
            yield batch.filter(pa.array(tails[:, -1] >= min_tail if tails.shape[1] else np.ones(len(score), bool)))
        _memo.clear()
        give_back()

    return docs.mapInArrow(kept, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """One id in five is never learned from, so that accuracy can be measured on it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grades(labels: DataFrame) -> DataFrame:
    """Toxic texts have grade 0, other poor ones 1, good ones 2."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, grades(labels).filter(~held_out()))
    return rate(docs, model).select("doc_id", held_out().alias("held_out"), "expected_grade", "p_top", (F.col("p_top") >= MIN_TAIL).alias("selected"))


QUERIES = {"op9_quality": op9_quality}
ORACLES: dict[str, str] = {}
