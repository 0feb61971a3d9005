"""Queries over the stored index (M01, M02), and evaluation of all search modes over it (E01, E02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import fixture, table
from traceframe.library.retrieval import _BM25, _POST, _TOK, ASK
from traceframe.operators import search as R
from traceframe.operators import text_index as T
from traceframe.plans.scratch import materialize, scratch_path

COLUMNS = {"source": 3.0, "text": 1.0}
#: Tokens of an item that a document has to hold in one stretch to be gold for it.
STRETCH = 8

_stored: dict[tuple[str, str], T.Index] = {}


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text")


def built(spark: SparkSession, d: str) -> T.Index:
    """The index of documents; built at the first call of a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _stored:
        _stored[at] = T.create(_docs(spark, d), scratch_path(spark, "blocks_index"), "doc_id", COLUMNS)
    return _stored[at]


@query("m02_block_bounds", f"WITH {_POST}, {_BM25} SELECT doc_id, score, rank FROM keyword WHERE rank <= 10")
def m02_blocks(spark: SparkSession, d: str) -> DataFrame:
    """As m02, over the stored blocks: those whose bound is too low are not read."""
    terms = fixture(spark, "q int, text string", [(1, ASK)]).select("q", F.explode(R.tokens(F.col("text"))).alias("term"))
    return T.top(spark, built(spark, d), terms, "q", 10)[0].select("doc_id", "score", "rank")


@query("m01_merged_segments", f"WITH {_POST} SELECT term, doc_id, tf, length FROM posted JOIN length USING (doc_id)")
def m01_merged(spark: SparkSession, d: str) -> DataFrame:
    """As m01, after one language was added to the others, one source deleted and put back, and all was merged."""
    every, docs, path = table(spark, d, "documents"), _docs(spark, d), scratch_path(spark, "segments")
    own = lambda which: every.filter(which).select(docs.columns)
    index = T.create(own("lang is distinct from 'es'"), path, "doc_id", COLUMNS)
    index = T.add(index, own("lang = 'es'"))
    source = docs.filter(F.col("source") == "src0")
    index = T.add(T.remove(index, source), source)
    return T.live_postings(spark, T.merge(spark, index)).select("term", "doc_id", F.col("tf").cast("double").alias("tf"), "length")


_HEX = "instr('0123456789abcdef', substr(md5(token), {}, 1)) - 1"
_SQL = f"""{_POST}, asked AS (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
  weighed AS (SELECT item_id, term, count(*) * greatest(ln(((SELECT count(*) FROM documents) - any_value(df) + 0.5) / (any_value(df) + 0.5)), 1e-6) AS weight FROM asked JOIN df USING (term) GROUP BY 1, 2),
  scored AS (SELECT item_id, doc_id, round(sum(weight * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / (SELECT avg(length) FROM length)))), 6) AS score FROM weighed JOIN posted USING (term) JOIN length USING (doc_id) GROUP BY 1, 2),
  keyword AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 60),
  every_token AS (SELECT doc_id AS id, unnest({_TOK.format('text')}) AS token FROM documents UNION ALL SELECT -1 - item_id, unnest({_TOK.format('text')}) FROM benchmark),
  places AS (SELECT id, (({_HEX.format(1)}) * 16 + {_HEX.format(2)}) % 64 AS place, sum(CASE WHEN {_HEX.format(3)} >= 8 THEN 1 ELSE -1 END) AS n FROM every_token GROUP BY 1, 2),
  vectors AS (SELECT id, list(coalesce(n, 0)::DOUBLE ORDER BY place) AS v FROM (SELECT id, place FROM (SELECT DISTINCT id FROM places), (SELECT unnest(range(64)) AS place)) LEFT JOIN places USING (id, place) GROUP BY 1),
  near AS (SELECT -1 - q.id AS item_id, d.id AS doc_id, coalesce(round(list_cosine_similarity(q.v, d.v), 6), 0) AS score FROM vectors q JOIN vectors d ON q.id < 0 AND d.id >= 0),
  vector AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 60),
  fused AS (SELECT item_id, doc_id, round(sum(w / (60 + rank)), 9) AS score, min({{'g': g, 'r': rank}}) AS first FROM (SELECT *, 0 AS g, 0.5 AS w FROM keyword UNION ALL SELECT *, 1, 1.0 FROM vector) GROUP BY 1, 2),
  hybrid AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM fused),
  ranked AS (SELECT 'bm25' AS mode, * FROM keyword UNION ALL SELECT 'vector', * FROM vector UNION ALL SELECT 'hybrid', * FROM hybrid),
  gold AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, ' ' || array_to_string({_TOK.format('text')}[1:{STRETCH}], ' ') || ' ' AS stretch FROM benchmark WHERE len({_TOK.format('text')}) >= {STRETCH})
    JOIN (SELECT doc_id, ' ' || array_to_string({_TOK.format('text')}, ' ') || ' ' AS whole FROM documents) ON contains(whole, stretch)),
  asked_for AS (SELECT mode, item_id FROM (SELECT DISTINCT item_id FROM gold), (SELECT unnest(['bm25', 'vector', 'hybrid']) AS mode)),
  first AS (SELECT a.mode, a.item_id, min(r.rank) AS rank FROM asked_for a LEFT JOIN (ranked r SEMI JOIN gold USING (item_id, doc_id)) ON r.mode = a.mode AND r.item_id = a.item_id AND r.rank <= 10 GROUP BY 1, 2)"""


def _by_mode(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rankings of each benchmark item over all documents by mode, and the rank of the first gold one (null: none of the ten best)."""
    docs, items = table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "benchmark").select("item_id", "text")
    terms = items.select("item_id", F.explode(R.tokens(F.col("text"))).alias("term"))
    keyword = T.top(spark, built(spark, d), terms, "item_id", R.CANDIDATES)[0].select("item_id", "doc_id", "rank")
    asked = R.hashed_vectors(items.select((-1 - F.col("item_id")).alias("doc_id"), "text"), "doc_id", "text")  # numbers that no document has
    near = R.nearest(R.hashed_vectors(docs, "doc_id", "text"), asked, "doc_id", "vector", R.CANDIDATES)
    vector = near.select((-1 - F.col("query")).alias("item_id"), "doc_id", "rank")
    ranked = materialize(R.ranked_by_mode(materialize(keyword, "keyword"), materialize(vector, "vector"), "item_id", "doc_id"), "ranked")
    gold = materialize(R.holding(docs, "doc_id", items, "item_id", "text", STRETCH), "gold")
    hits = ranked.filter("rank <= 10").join(gold, ["item_id", "doc_id"], "left_semi").groupBy("mode", "item_id").agg(F.min("rank").alias("rank"))
    every = gold.select("item_id").distinct().select("item_id", F.explode(F.array(*map(F.lit, ("bm25", "vector", "hybrid")))).alias("mode"))
    return ranked, every.join(hits, ["mode", "item_id"], "left")


@query("e01_recall_by_mode", f"WITH {_SQL} SELECT mode, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr10 FROM first GROUP BY 1")
def e01_modes(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, vector and hybrid search for every benchmark item; gold are the documents that hold its first words."""
    return R.recall_mrr(_by_mode(spark, d)[1], ["mode"]).filter("mode is not null")


@query("e02_hybrid_misses", f"WITH {_SQL} SELECT item_id, list(doc_id ORDER BY rank) FILTER (rank <= 3) AS best FROM hybrid WHERE item_id IN (SELECT item_id FROM first WHERE mode = 'hybrid' AND (rank IS NULL OR rank > 5)) GROUP BY 1")
def e02_modes(spark: SparkSession, d: str) -> DataFrame:
    """Items that hybrid search misses among its first five, with what it found best."""
    ranked, first = _by_mode(spark, d)
    missed = first.filter("mode = 'hybrid' and (rank is null or rank > 5)").select("item_id")
    best = ranked.filter("mode = 'hybrid' and rank <= 3").join(missed, "item_id", "left_semi")
    return best.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("best"))
