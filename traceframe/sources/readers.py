"""Sources: file trees, configuration tables, analyser exports, logs."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions.text import unquoted

# Suffixes that are read, folders that are not, and known reference types.
SUFFIXES, SKIPPED = ["gms", "r", "rmd", "md"], [".git", "output", "renv", "node_modules"]
REFERENCE_TYPES = ["declared", "defined", "assigned", "impl-asn", "ref", "control"]


def decode(content: Column) -> Column:
    """UTF-8, else Latin-1, so that no file is lost."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def source_files(spark: SparkSession, root: str, suffixes: list[str] = SUFFIXES, extra: list[str] | None = None, skipped: list[str] = SKIPPED) -> DataFrame:
    """path (relative to the root) and text of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    path = F.substring_index(F.col("path"), base + "/", -1)
    suffix = F.lower(F.substring_index(path, ".", -1))
    wanted = suffix.isin(suffixes) | F.element_at(F.split(path, "/"), -1).isin(extra or [])
    clear = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in skipped]))
    return files.filter(wanted & clear).select(path.alias("path"), decode(F.col("content")).alias("text"))


def tracked_only(files: DataFrame, listing: DataFrame | None) -> DataFrame:
    """Files of the version control's listing (path); all, if there is none."""
    return files if listing is None else files.join(listing.select("path").distinct(), "path", "left_semi")


def staleness(built: str | None, head: str | None) -> str:
    """A sentence if the snapshot was built from another commit than is checked out."""
    if not built or not head or built == head:
        return ""
    return f"The snapshot was built from {built[:10]}; the checkout is at {head[:10]}."


def git_head(root: str) -> str | None:
    """Commit of a checkout, read from its files; None if there is none."""
    try:
        with open(os.path.join(root, ".git", "HEAD"), encoding="utf-8") as f:
            head = f.read().strip()
        if not head.startswith("ref: "):
            return head
        with open(os.path.join(root, ".git", head[5:]), encoding="utf-8") as f:
            return f.read().strip()
    except OSError:
        return None


def scenario_rows(lines: DataFrame, sep: str = ";") -> DataFrame:
    """path, line, name, parent and cells of config tables given as lines (path, n, line).

    The first line of each file is the header; empty rows and those whose first cell begins
    with # are skipped, rows may be short, blank cells are absent, of columns with one name
    the last counts.
    """
    cell = rf'(?:^|{re.escape(sep)})("(?:[^"]|"")*"|[^{re.escape(sep)}]*)'
    found = F.regexp_extract_all("line", F.lit(cell), F.lit(1))
    bare = F.transform(found, lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))
    rows = lines.filter(F.trim("line") != "").select("path", "n", bare.alias("cells"))
    heads = rows.groupBy("path").agg(F.min_by("cells", "n").alias("names"), F.min("n").alias("head"))
    body = rows.join(heads, "path").filter((F.col("n") > F.col("head")) & F.coalesce(~F.get("cells", 0).startswith("#") & (F.get("cells", 0) != ""), F.lit(False)))
    pairs = F.filter(F.zip_with("names", "cells", lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda p: p["key"].isNotNull() & F.coalesce(p["value"] != "", F.lit(False)))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    mapped = F.map_from_entries(F.filter(last, lambda p: ~p["key"].isin("title", "copyConfigFrom")))
    return body.select("path", F.col("n").alias("line"), F.get("cells", 0).alias("name"), _cell(last, "copyConfigFrom").alias("parent"), mapped.alias("cells"))


def _cell(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["key"] == key), 0)["value"]


def key_values(lines: DataFrame) -> DataFrame:
    """key (lower case) and value of ``cfg$name <- value`` lines (n, line); nested names are skipped, the last wins."""
    code = F.regexp_replace("line", "#.*$", "")
    found = lines.select("n", F.regexp_extract(code, r"^\s*cfg\$(\w+)\s*<-\s*(.*?)\s*$", 1).alias("key"), F.regexp_extract(code, r"^\s*cfg\$(\w+)\s*<-\s*(.*?)\s*$", 2).alias("value"))
    return found.filter("key <> ''").groupBy(F.lower("key").alias("key")).agg(F.max_by(unquoted(F.col("value")), "n").alias("value"))


def analyser_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Interfaces and unused names of an analyser's JSON export, as tables."""
    raw = spark.read.option("multiLine", True).json(path)
    out = {}
    for name in ("interfaces", "not_used", "declarations", "modules"):
        if dict(raw.dtypes).get(name, "").startswith("array<struct"):
            out[name] = raw.select(F.explode(name).alias("r")).select("r.*")
    return out


def not_used(spark: SparkSession, root: str) -> DataFrame:
    """name, type, reason, module and realization of the lists of unused names."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "not_used.txt").text(root).withColumn("path", F.input_file_name())
    cells = F.from_csv("value", F.lit("name string, type string, reason string"), {"comment": "#"})
    parts = F.split("path", "/")
    named = files.filter("trim(value) <> '' and not value like '#%'").select(cells.alias("c"), F.element_at(parts, -3).alias("module"), F.element_at(parts, -2).alias("realization"))
    return named.select("c.*", "module", "realization").filter("name <> 'name'")


def reference_entries(lines: DataFrame) -> DataFrame:
    """Entries of a compiler's reference file (value): known types with a numeric line."""
    p = F.split("value", r"\s+", 10)
    cut = lines.filter(F.size(p) >= 10).select(*[F.get(p, i).alias(c) for i, c in enumerate(["id", "name", "type", "reftype", "global_line", "line", "column", "level", "file", "path"])])
    return cut.filter(F.col("reftype").isin(REFERENCE_TYPES) & F.col("line").rlike(r"^\d+$")).withColumn("line", F.col("line").cast("int"))


def listing_lines(lines: DataFrame) -> DataFrame:
    """line and code of a compiler listing (n, value); the first occurrence of a number wins."""
    pattern = r"^ *(\d{1,9})  (.*)$"
    found = lines.filter(F.col("value").rlike(pattern)).select("n", F.regexp_extract("value", pattern, 1).cast("int").alias("line"), F.regexp_extract("value", pattern, 2).alias("code"))
    return found.groupBy("line").agg(F.min_by("code", "n").alias("code"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from a JSON file: id, type, question, gold, must_contain, answer."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    return spark.createDataFrame([(r["id"], r["type"], r["question"], r["gold"], r.get("must_contain"), r.get("answer")) for r in rows], "id string, type string, question string, gold array<string>, must_contain string, answer string")


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a Markdown table; rows in the order of the columns."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns)
    return df.select(row.alias("r")).agg(F.concat(F.lit(head + "\n"), F.array_join(F.sort_array(F.collect_list("r")), "\n")).alias("text"))


def safe_name(text: str) -> str:
    return re.sub(r"\W+", "_", text)
