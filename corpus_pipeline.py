"""Pipeline from raw documents to packed sequences.

Each stage takes (session, documents, folder of the tables) and gives a table, which is
written as Parquet in the shared folder and read again as the next stage's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.llm import decontamination, line_dedup, near_dedup, packing, quality
from traceframe.llm.tokens import public_path
from traceframe.plans.scratch import materialize, scratch_path, scratch_scope
from traceframe.plans.sizing import bounded_broadcast

#: Near duplicates share this much of their 5-word shingles, in hundredths.
SIMILARITY = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are most likely of the highest grade; toxic and poor ones go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, quality.grades(labels).filter(~quality.held_out()))
    return quality.select(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus, but for an edit, are cut; documents that had nothing else go, as do rows that are repeated."""
    found = line_dedup.dedup_lines(docs)
    gone = (F.col("n_removed") > 0) & (F.trim(F.replace("text", F.lit("\n"), F.lit(""))) == "")
    kept = found.filter(~F.coalesce(gone, F.lit(False)))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = near_dedup.find_components(docs, similarity=SIMILARITY)
    copies = materialize(found.filter(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(bounded_broadcast(copies), "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their ids; workers of later stages need the memory of its cache."""
    return packing.pack(docs, public_path("byte_bpe_50k.json"), keep_cache=False)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` to sequences; what a stage wrote on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "_"))
        with scratch_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
