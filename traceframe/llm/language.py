"""Language of whole texts: scripts narrow the candidates, Viterbi labels the words.

Model.  From labelled texts, log probabilities of hashed character 1- to 3-grams of each
language (word ends count as characters), and the share of each script among each
language's words.  A word's script is that of its first letter, from a table of code
point ranges; languages in which that script is rare are no candidates for the word.
A word scores the sum of its grams' log probabilities for each candidate, and Viterbi
with a fixed penalty for each change of language finds the best labelling of the words.
Runs of words with one label are the spans; the language with most letters is the
text's, and its share of all letters is the score.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to
the language first in alphabetical order; repeated rows are labelled once each; other
columns are not read; with no labelled text everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many labelled rows of each language are learned from, chosen by a hash of the id.
SAMPLE_PER_LANG = 2_000
#: Hash buckets of grams, penalty of a change, least share of a script.
BUCKETS, SWITCH, MIN_SCRIPT = 1 << 16, 12.0, 0.001
#: Code points scored at a time, and characters of the texts in one Viterbi run, each times the number of languages.
CHUNK, GROUP = 4_000_000, 32_000_000

# First code points of the Unicode ranges that tell scripts apart.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "odia"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0x10000, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_IDS = np.array([_NAMES.index(n) for _, n in SCRIPTS])
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, its lower-case form if it is a letter, else 0; made once a process."""
    if not _tables:
        points = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                points[c] = ord(low) if len(low := s.lower()) == 1 else c
        _tables.append(points)
    return _tables[0]


@dataclass(frozen=True)
class Model:
    """langs in order; log probabilities by bucket and language; which languages a script allows."""

    langs: list[str]
    gram: np.ndarray
    allowed: np.ndarray


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, and the lower-cased code points."""
    low = _letters()[points]
    inside = np.concatenate([[False], low > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2], low


def _grams(low: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 1-, 2- and 3-gram that ends at each code point; they end at a word's start."""
    a = low.astype(np.uint64)
    b, c = np.zeros_like(a), np.zeros_like(a)
    b[1:] = a[:-1]
    c[2:] = a[:-2]
    c[b == 0] = 0
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    two = a * np.uint64(1_000_003) + b + np.uint64(1)
    return [mix(a), mix(two * np.uint64(31)), mix(two * np.uint64(1_000_033) + c * np.uint64(131) + np.uint64(7))]


def _script(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _IDS[np.searchsorted(_STARTS, low[starts], "right") - 1]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a blank after each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(sizes)])


def _groups(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have about so many characters together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a text and a label: about SAMPLE_PER_LANG rows of each language.

    Every label is a language, however rare, if its texts hold a letter.  Only counts reach
    the driver: at most languages x buckets rows; the model takes 256 KB a language.
    """
    own = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = own.filter("lang is not null").groupBy("lang").count().collect()
    langs = sorted(r.lang for r in sizes)
    number = {lang: k for k, lang in enumerate(langs)}
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    shares = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, SAMPLE_PER_LANG / r["count"]) * (1 << 30)) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))
    sample = own.filter("text is not null").join(F.broadcast(shares), "lang").filter(draw < F.col("share"))  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(_NAMES)), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True):
                starts, ends, low = _words(_joined([text])[0])
                if len(starts):
                    k, inside = number[lang], low > 0
                    inside[1:] |= inside[:-1].copy()
                    for g in _grams(low):
                        grams[k] += np.bincount(g[inside], minlength=BUCKETS)
                    scripts[k] += np.bincount(_script(low, starts), minlength=len(_NAMES))
        for kind, table in (("gram", grams), ("script", scripts)):
            k, j = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.string()), pa.array(k), pa.array(j), pa.array(table[k, j])], names=["kind", "k", "j", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "kind string, k bigint, j bigint, n bigint")
    found = counts.groupBy("kind", "k", "j").agg(F.sum("n").alias("n")).toPandas()
    tables = {"gram": np.zeros((len(langs), BUCKETS)), "script": np.zeros((len(langs), len(_NAMES)))}
    for kind, rows in found.groupby("kind"):
        tables[kind][rows.k.to_numpy(), rows.j.to_numpy()] = rows.n.to_numpy()
    lettered = tables["script"].sum(1) > 0
    langs = [lang for lang, has in zip(langs, lettered, strict=True) if has]
    gram, script = tables["gram"][lettered] + 0.5, tables["script"][lettered]
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    logs = np.log(gram / gram.sum(1, keepdims=True)).T
    allowed = (script / np.maximum(script.sum(1, keepdims=True), 1) >= MIN_SCRIPT).T
    return Model(langs, np.ascontiguousarray(logs - logs.mean(1, keepdims=True), np.float32), allowed)


def _scores(model: Model, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of each word for each language; a word takes the blank after it along."""
    out = np.empty((len(starts), len(model.langs)), np.float32)
    lo, size = 0, max(1, CHUNK // len(model.langs))
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + size)))
        own = low[starts[lo] : ends[hi - 1] + 1]
        per = np.zeros((len(own) + 1, len(model.langs)), np.float32)
        for g in _grams(own):
            per[:-1] += model.gram[g]
        cuts = np.stack([starts[lo:hi], ends[lo:hi] + 1], 1).ravel() - starts[lo]
        out[lo:hi] = np.add.reduceat(per, cuts, axis=0)[::2]
        lo = hi
    may = model.allowed[_script(low, starts)]
    out[~(may | ~may.any(1, keepdims=True))] = -1e6
    return out


def _viterbi(score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Labels of the words of all texts, word by word over the texts that still have one."""
    label = np.zeros(len(score), np.int16)
    if not len(score):
        return label
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    longest = int(sizes[order[0]])
    alive = np.searchsorted(-sizes[order], -np.arange(longest), "left")
    value = score[first[: alive[0]]]
    stay, before = np.ones(score.shape, bool), np.zeros(len(score), np.int16)
    for t in range(1, longest):
        n, at = alive[t], first[: alive[t]] + t
        best = value[:n].argmax(1)
        change = value[np.arange(n), best] - SWITCH
        before[at] = best
        stay[at] = value[:n] >= change[:, None]
        value[:n] = np.maximum(value[:n], change[:, None]) + score[at]
    now = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        n, at = alive[t], first[: alive[t]] + t
        label[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], before[at])
    return label


def label_texts(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language; code points) of each text."""
    if not model.langs:
        return [("und", 0.0, []) for _ in texts]
    out = []
    for lo, hi in _groups(texts, max(1, GROUP // len(model.langs))):
        points, begins = _joined(texts[lo:hi])
        starts, ends, low = _words(points)
        doc = np.searchsorted(begins, starts, "right") - 1
        sizes = np.bincount(doc, minlength=hi - lo)
        label = _viterbi(_scores(model, low, starts, ends), sizes)
        letters = np.zeros((hi - lo, len(model.langs)))
        np.add.at(letters, (doc, label), ends - starts)
        change = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])) if len(doc) else np.zeros(0, int)
        last = np.concatenate([change[1:], [len(doc)]]) - 1 if len(doc) else change
        spans: list[list] = [[] for _ in range(hi - lo)]
        for d, s, e, k in zip(doc[change].tolist(), starts[change].tolist(), ends[last].tolist(), label[change].tolist(), strict=True):
            spans[d].append((s - int(begins[d]), e - int(begins[d]), model.langs[k]))
        for d, row in enumerate(letters):
            out.append((model.langs[int(row.argmax())], float(row.max() / row.sum()), spans[d]) if row.any() else ("und", 0.0, []))
    return out


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and spans of every whole text; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 4_000):
                found = label_texts(shared.value, texts[lo : lo + 4_000])
                spans = [[{"start": s, "end": e, "lang": x} for s, e, x in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo : lo + 4_000], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, pa.list_(span))],
                    names=["id", "lang_pred", "score", "spans"],
                )

    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = own.mapInArrow(label, f"id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
    return found.withColumnRenamed("id", id_col)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs.filter(~held_out & F.col("lang").isNotNull()))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op1_language": op1_language}
ORACLES: dict[str, str] = {}
