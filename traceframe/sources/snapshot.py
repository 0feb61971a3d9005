"""Snapshots: immutable folders of Parquet tables behind a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions.text import content_key, squeezed, visible
from traceframe.operators.quality import gate
from traceframe.sources import pointers

SCHEMA_VERSION = 1


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict[str, str], partition: dict[str, list[str]] | None = None) -> str:
    """Write all tables below a new folder and return it; nothing points at it yet."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write
        if by := (partition or {}).get(name):
            writer = writer.partitionBy(*by)
        writer.parquet(f"{path}/{name}")
    rows = sorted({**meta, "schema_version": str(SCHEMA_VERSION)}.items())
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{path}/meta")
    return path


def publish(spark: SparkSession, root: str, path: str) -> int:
    """Let the pointer name a written snapshot: a new generation, put in place by one rename."""
    return pointers.advance(spark, f"{root.rstrip('/')}/current", path)


def current(spark: SparkSession, root: str) -> str:
    """The snapshot that was published last."""
    found = pointers.latest(spark, f"{root.rstrip('/')}/current")
    if found is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    return found[1]


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a snapshot; one of another schema version is refused."""
    version = read_meta(spark, path).get("schema_version")
    if version != str(SCHEMA_VERSION):
        raise ValueError(f"{path} has schema version {version}, not {SCHEMA_VERSION}: build it again")
    return spark.read.parquet(f"{path}/{table}")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}


def promote(spark: SparkSession, root: str, path: str, old: DataFrame, new: DataFrame, warnings: int) -> bool:
    """Publish if the gate allows it: metrics are tables (mode, recall5, mrr10)."""
    fine = gate(old, new, warnings, "mode", ["recall5", "mrr10"])
    if fine:
        publish(spark, root, path)
    return fine


def keyed(chunks: DataFrame, model: str, length: int = 1000) -> DataFrame:
    """Chunks with the key of what a model sees of them."""
    return chunks.withColumn("key", content_key(F.lit(model), visible(squeezed(F.col("header"), F.col("text")), length)))


def embed(chunks: DataFrame, cache: DataFrame | None, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key and vector of keyed chunks: those in the cache are reused, each other distinct key is embedded once.

    ``embedder`` takes (key, text) and gives (key, vector); it gets the texts of a task in
    the order of their lengths, so that batches have texts of like length.
    """
    by_length = lambda df: df.repartition(F.xxhash64("key")).sortWithinPartitions(F.length("text"), "key")
    wanted = chunks.groupBy("key").agg(F.min(squeezed(F.col("header"), F.col("text"))).alias("text"))
    if cache is None:
        return embedder(by_length(wanted))
    known = cache.join(wanted.select("key"), "key", "left_semi").select("key", "vector").dropDuplicates(["key"])
    return known.unionByName(embedder(by_length(wanted.join(cache.select("key"), "key", "left_anti"))))


def tables(spark: SparkSession, path: str) -> DataFrame:
    """table, column and type of all tables of a snapshot."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    names = sorted(f.getPath().getName() for f in found if f.isDirectory())
    rows = [(n, column, kind) for n in names for column, kind in spark.read.parquet(f"{path}/{n}").dtypes]
    return spark.createDataFrame(rows, "table string, column string, type string")
