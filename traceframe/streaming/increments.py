"""Extensions for streams: increments of chunks, and running totals of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_chunks(spark: SparkSession, source: str, schema: str, known: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append chunks with a new content key to ``out``; keys written before (in ``known`` or ``out``) are left out.

    Each batch is an anti join by key, so a batch that is run again appends nothing twice.
    """

    def append(batch: DataFrame, _: int) -> None:
        keys = batch.sparkSession.read.parquet(known).select("key")
        try:
            keys = keys.union(batch.sparkSession.read.parquet(out).select("key"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.dropDuplicates(["key"]).join(keys, "key", "left_anti").write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window and kind; late ones are taken up to the watermark (works on streams and tables)."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select("w.start", kind, "n")
