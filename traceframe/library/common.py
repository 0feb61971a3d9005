"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, dict):
        return "map([" + ", ".join(map(_literal, value)) + "], [" + ", ".join(map(_literal, value.values())) + "])"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """The same rows as a common table expression: ``name(columns) AS (VALUES ...)``."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def documents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n (from 1) and line of every document."""
    from traceframe.functions.lines import lines

    return lines(table(spark, sf_dir, "documents"), "doc_id", "text")


#: The same as documents_lines; one trailing empty line is dropped.
LINES_SQL = """lines AS (
  SELECT doc_id, i AS n, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(generate_series(1, len(parts) - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) AS i
    FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS parts FROM documents WHERE text IS NOT NULL)))"""
