"""Reports as ordered parts of text: written by all tasks, header once, with a manifest of the parts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.sources import pointers


def markdown_row(columns: list[str]) -> Column:
    """The row of a Markdown table; bars are escaped and line ends become blanks."""
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ") for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def write_report(df: DataFrame, path: str, columns: list[str], order: list[str], title: str = "", parts: int | None = None) -> dict:
    """Write ``df`` as a Markdown table below ``path`` and return the manifest.

    Rows are dealt out by ranges of ``order`` and sorted in each, so the parts follow one
    another and no task holds more than its range; the manifest (header and number of parts)
    is put in place last, in one step, so a report is read whole or not at all.
    """
    head = ([f"# {title}", ""] if title else []) + ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    ranged = df.repartitionByRange(*([parts] if parts else []), *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)  # in the order that the writer wants, else it sorts anew
    lines = ranged.select(markdown_row(columns).alias("value"), F.col("_part").alias("part"))
    lines.write.partitionBy("part").text(f"{path}/parts")
    stored = df.sparkSession.read.schema("value string, part int").text(f"{path}/parts")
    rows = {r.part: r.n for r in stored.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each part
    manifest = {"head": head, "columns": columns, "order": order, "parts": [{"part": p, "rows": rows[p]} for p in sorted(rows)]}
    pointers.advance(df.sparkSession, f"{path}/manifest", json.dumps(manifest))
    return manifest


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """part, place and line of a report, the header as part -1; order by part and place gives the text."""
    found = pointers.latest(spark, f"{path}/manifest")
    if found is None:
        raise FileNotFoundError(f"no whole report in {path}")
    manifest = json.loads(found[1])
    held = [p["part"] for p in manifest["parts"]]
    body = spark.read.schema("value string, part int").text(f"{path}/parts").filter(F.col("part").isin(held))
    body = body.select("part", F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    head = spark.createDataFrame([(-1, i, line) for i, line in enumerate(manifest["head"])], "part int, place bigint, line string")
    return head.unionByName(body)
