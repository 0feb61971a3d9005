"""Retrieval M01-M14 and its evaluation E01, E02, A12, A13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.catalog import query
from traceframe.library.common import fixture, table, values
from traceframe.operators import search as R
from traceframe.plans.scratch import scratch_path

ASK = "the tion of with them and that"
_TOK = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
_POST = f"""every AS (SELECT doc_id, unnest({_TOK.format('source')}) AS term, 3.0 AS w FROM documents UNION ALL SELECT doc_id, unnest({_TOK.format('text')}), 1.0 FROM documents),
  length AS (SELECT doc_id, count(*) AS length FROM every GROUP BY 1), posted AS (SELECT term, doc_id, sum(w)::DOUBLE AS tf FROM every GROUP BY 1, 2)"""
_SCORE = """sum(greatest(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / (SELECT avg(length) FROM length))))"""
_BM25 = f"""terms AS (SELECT unnest({_TOK.format("'" + ASK + "'")}) AS term), df AS (SELECT term, count(*) AS df FROM posted GROUP BY 1),
  bm AS (SELECT doc_id, round({_SCORE}, 6) AS score FROM posted JOIN terms USING (term) JOIN df USING (term) JOIN length USING (doc_id) GROUP BY 1),
  keyword AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm)"""
_KNN = """near AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings WHERE vec_id <> 7),
  vector AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM near)"""


def _posted(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(table(spark, d, "documents").select("doc_id", "source", "text"), "doc_id", {"source": 3.0, "text": 1.0})


def _scan(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Ranking without an index: one pass over the texts."""
    terms = fixture(spark, "q int, text string", [(1, ASK)]).select("q", F.explode(R.tokens(F.col("text"))).alias("term"))
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    scored = R.bm25_scan(docs, terms, "doc_id", {"source": 3.0, "text": 1.0}, ["q"])
    return R.top(scored, ["q"], "doc_id", n)


def _vector(spark: SparkSession, d: str, n: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = e.filter("vec_id = 7").first()
    near = e.filter("vec_id <> 7").select(F.lit(1).alias("q"), F.col("vec_id").alias("doc_id"), F.round(R.cosine_to(F.col("embedding"), asked.embedding), 6).alias("score"))
    return R.top(near.orderBy(F.desc("score"), "doc_id").limit(n), ["q"], "doc_id", n)


@query("m01_postings", f"WITH {_POST} SELECT term, doc_id, tf, length FROM posted JOIN length USING (doc_id)")
def m01(spark: SparkSession, d: str) -> DataFrame:
    return _posted(spark, d)


@query("m02_bm25", f"WITH {_POST}, {_BM25} SELECT doc_id, score, rank FROM keyword WHERE rank <= 10")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d, 10).select("doc_id", "score", "rank")


_stored: dict[tuple[str, str], tuple[str, int, float]] = {}


def _index(spark: SparkSession, d: str) -> tuple[str, int, float]:
    """Folder of the stored postings, the number of documents and their mean length; written at the first call of a session."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _stored:
        path = scratch_path(spark, "index")
        _posted(spark, d).sortWithinPartitions("term").write.parquet(f"{path}/postings")  # each file has the terms of some rows in order
        stats = R.index_stats(spark.read.parquet(f"{path}/postings"), "doc_id").first()
        _stored[at] = (path, table(spark, d, "documents").count(), stats.average)
    return _stored[at]


def _keyword(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Ranking over the stored index."""
    path, docs, average = _index(spark, d)
    terms = fixture(spark, "q int, text string", [(1, ASK)]).select("q", F.explode(R.tokens(F.col("text"))).alias("term"))
    return R.top(R.bm25(spark.read.schema("term string, doc_id bigint, tf double, length bigint").parquet(f"{path}/postings"), docs, average, terms, "doc_id", ["q"]), ["q"], "doc_id", n)


@query("m02_bm25_stored", f"WITH {_POST}, {_BM25} SELECT doc_id, score, rank FROM keyword WHERE rank <= 10")
def m02_stored(spark: SparkSession, d: str) -> DataFrame:
    """As m02, over the stored index."""
    return _keyword(spark, d, 10).select("doc_id", "score", "rank")


@query("m03_knn", f"WITH {_KNN} SELECT doc_id, score, rank FROM vector WHERE rank <= 20")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return _vector(spark, d, 20).select("doc_id", "score", "rank")


@query("m04_known_identifiers", "SELECT DISTINCT w AS name FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark) WHERE w IN (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) FROM conversations)")
def m04(spark: SparkSession, d: str) -> DataFrame:
    words = lambda t: table(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    return words("benchmark").distinct().join(words("conversations"), "name", "left_semi")


SOURCES = [("cm_a", 1, 0, 11), ("cm_a", 2, 0, 12), ("cm_a", 4, 0, 13), ("cm_a", 4, 1, 11), ("vm_x", 2, 0, 12), ("vm_x", 3, 0, 14), ("vm_x", 4, 0, 15)]


@query("m05_definition_ranking", f"WITH {values('t', 'name, source, sub, doc_id', SOURCES)}, f AS (SELECT doc_id, min({{'n': name, 's': source, 'k': sub}}) AS first FROM t GROUP BY 1) SELECT doc_id, row_number() OVER (ORDER BY first) AS rank FROM f")
def m05(spark: SparkSession, d: str) -> DataFrame:
    """Per name: switch, equation, declaration, interface; each chunk at its first place."""
    t = fixture(spark, "name string, source int, sub int, doc_id int", SOURCES)
    first = t.groupBy("doc_id").agg(F.min(F.struct("name", "source", "sub")).alias("first"))
    return first.select("doc_id", F.row_number().over(Window.orderBy("first")).cast("bigint").alias("rank"))


_FUSED = """SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score, min({'g': g, 'r': rank}) AS first FROM (SELECT doc_id, rank, 0 AS g, 0.5 AS w FROM keyword WHERE rank <= 60 UNION ALL SELECT doc_id, rank, 1, 1.0 FROM vector WHERE rank <= 60) GROUP BY 1"""


@query("m07_rrf", f"WITH {_POST}, {_BM25}, {_KNN}, f AS ({_FUSED}) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, first) AS rank FROM f")
def m07(spark: SparkSession, d: str) -> DataFrame:
    n = R.CANDIDATES
    return R.fuse([(_keyword(spark, d, n), 0.5), (_vector(spark, d, n), 1.0)], ["q"], "doc_id").select("doc_id", "score", "rank")


@query("m08_weights_by_mode", f"WITH {_POST}, {_BM25} SELECT doc_id, round(1.0 / (60 + rank), 9) AS score, rank FROM keyword WHERE rank <= 60")
def m08(spark: SparkSession, d: str) -> DataFrame:
    """Keyword mode, or a query that names an identifier: full weight."""
    return R.fuse([(_keyword(spark, d, R.CANDIDATES), 1.0)], ["q"], "doc_id").select("doc_id", "score", "rank")


@query("m10_rescored_by_setting", f"WITH {_POST}, {_BM25}, {_KNN}, f AS ({_FUSED}) SELECT doc_id, round(score * CASE WHEN lang = 'en' THEN 1.0 ELSE 0.3 END, 9) AS score FROM f JOIN documents USING (doc_id) WHERE source <> 'src0'")
def m10(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of what is not selected go; those with a false condition count for less."""
    factor = F.when(F.col("lang") == "en", 1.0).otherwise(R.OUT_OF_SETTING)
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").filter("source <> 'src0'")
    return m07(spark, d).join(docs, "doc_id").select("doc_id", F.round(F.col("score") * factor, 9).alias("score"))


_FILTERED = _FUSED.replace("rank <= 60", f"rank <= {R.CANDIDATES_FILTERED}")


@query("m11_post_filter", f"WITH {_POST}, {_BM25}, {_KNN}, f AS ({_FILTERED}) SELECT doc_id, score FROM (SELECT doc_id, score, first FROM f JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY score DESC, first LIMIT 5)")
def m11(spark: SparkSession, d: str) -> DataFrame:
    """Filters come after the candidates, of which there are more when a filter is set."""
    n = R.CANDIDATES_FILTERED
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    fused = R.fuse([(_keyword(spark, d, n), 0.5), (_vector(spark, d, n), 1.0)], ["q"], "doc_id")
    return fused.join(docs, "doc_id", "left_semi").orderBy("rank").limit(5).select("doc_id", "score")


@query("m12_rendered_hit", "SELECT doc_id, source || chr(10) || array_to_string(string_split(text, chr(10))[1:12], chr(10)) || CASE WHEN len(string_split(text, chr(10))) > 12 THEN chr(10) || '…' ELSE '' END AS shown FROM documents")
def m12(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    shown = F.concat("source", F.lit("\n"), F.array_join(F.slice(lines, 1, 12), "\n"), F.when(F.size(lines) > 12, "\n…").otherwise(""))
    return table(spark, d, "documents").select("doc_id", shown.alias("shown"))


@query("m14_reused_vectors", "SELECT a.doc_id, b.k IS NOT NULL AS reused FROM (SELECT doc_id, sha1('m|' || left(text, 1000)) AS k FROM documents) a LEFT JOIN (SELECT DISTINCT sha1('m|' || left(text, 1000)) AS k FROM documents WHERE lang <> 'es') b USING (k)")
def m14(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of an earlier snapshot are found by their content key; the rest is to be embedded."""
    from traceframe.functions.text import content_key, visible

    key = content_key(F.lit("m"), visible(F.col("text"))).alias("k")
    docs = table(spark, d, "documents")
    old = docs.filter("lang <> 'es'").select(key).distinct().withColumn("reused", F.lit(True))
    return docs.select("doc_id", key).join(old, "k", "left").select("doc_id", F.coalesce("reused", F.lit(False)).alias("reused"))


_RANKED = """ranked AS (SELECT q.vec_id AS query, q.label, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), first AS (SELECT query, label, min(rank) FILTER (hit AND rank <= 10) AS rank FROM ranked GROUP BY 1, 2)"""


def _first_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector against all rows, in blocks."""
    e = table(spark, d, "embeddings")
    labels = e.select("vec_id", "label")
    ranked = R.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    own = labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    told = ranked.join(labels, "vec_id").join(own, "query").select("query", "own", "rank", (F.col("label") == F.col("own")).alias("hit"))
    return told.groupBy("query", F.col("own").alias("label")).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))


@query("e01_recall_mrr", f"WITH {_RANKED} SELECT coalesce(label::VARCHAR, 'ALL') AS label, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall5, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr10 FROM first GROUP BY ROLLUP (label)")
def e01(spark: SparkSession, d: str) -> DataFrame:
    return R.recall_mrr(_first_hits(spark, d), ["label"]).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("ALL")))


@query("e02_misses", f"WITH {_RANKED} SELECT query, label FROM first WHERE rank IS NULL OR rank > 5")
def e02(spark: SparkSession, d: str) -> DataFrame:
    return _first_hits(spark, d).filter("rank is null or rank > 5").select("query", "label")


@query("a13_upper_median", "SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """Element n // 2 of the sorted values, counted from 0: equal values are counted first, so no group is gathered."""
    counts = table(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("event_type").orderBy(F.col("value").asc_nulls_first())
    total = F.sum("n").over(Window.partitionBy("event_type"))
    placed = counts.withColumn("upto", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", total)
    return placed.filter(F.floor(F.col("total") / 2) < F.col("upto")).groupBy("event_type").agg(F.min_by("value", "upto").alias("median"))
