"""Texts as tables of lines, and the state of a line that follows from its neighbours.

A table of lines has a key (a path or an id), ``n`` (from 1) and ``line``.  All windows are
partitioned by the key, so a file is the unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A quoted string: a run in double or in single quotes.
STRING = "\"[^\"]*\"|'[^']*'"
#: Markers of comments, text blocks and tails in the indexed language.
COMMENT, TAIL, BLOCK_ON, BLOCK_OFF = "*", "!!", r"(?i)^\$ontext", r"(?i)^\$offtext"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line; CRLF counts as LF and one trailing empty line is dropped."""
    parts = F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = df.select(key, F.posexplode(kept).alias("i", "line"))
    return rows.select(key, (F.col("i") + 1).alias("n"), "line")


def is_comment(line: Column, mark: str = COMMENT) -> Column:
    """Is the mark in the first column? An indented one is code."""
    return line.startswith(mark)


def code_part(line: Column, tail: str = TAIL) -> Column:
    """The line without quoted strings, cut at the tail mark."""
    return F.substring_index(F.regexp_replace(line, STRING, ""), tail, 1)


def cut_tail(line: Column, tail: str = TAIL) -> Column:
    """The line up to the tail mark outside strings; strings stay."""
    masked = F.regexp_replace(line, STRING, "")
    outside = F.instr(masked, tail)
    blanked = F.aggregate(F.regexp_extract_all(line, F.lit(STRING), F.lit(0)), line, lambda a, s: F.replace(a, s, F.repeat(F.lit("\u0001"), F.length(s))))
    return F.when(outside == 0, line).otherwise(F.substr(line, F.lit(1), F.instr(blanked, tail) - 1))


def ordered(key: str, *more: str) -> Window:
    return Window.partitionBy(key, *more).orderBy("n")


def in_block(rows: DataFrame, key: str, on: Column, off: Column) -> DataFrame:
    """Adds ``in_block``: from an opening line to the next closing one, both included; open ones run to the end."""
    mark = F.when(on, True).when(off, False)
    last = F.last(mark, ignorenulls=True).over(ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.last(mark, ignorenulls=True).over(ordered(key).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("in_block", F.coalesce(last, F.lit(False)) | (off & F.coalesce(before, F.lit(False))))


def strip_comments(rows: DataFrame, key: str, comment: Column, on: Column, off: Column, tail: str = TAIL) -> DataFrame:
    """key and text, without comment lines, blocks and tails; the lines stay in order."""
    kept = in_block(rows, key, on, off).filter(~F.col("in_block") & ~comment)
    cut = kept.select(key, "n", cut_tail(F.col("line"), tail).alias("line"))
    return cut.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))


def statement_end(rows: DataFrame, key: str, ends: Column) -> DataFrame:
    """Adds ``end``: the first line from here on that ends a statement, else the last line."""
    ahead = ordered(key).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("end", F.coalesce(F.min(F.when(ends, F.col("n"))).over(ahead), F.max("n").over(ahead)))


def statement_id(rows: DataFrame, key: str, ends: Column) -> DataFrame:
    """Adds ``statement``: the number of statements ended before the line."""
    before = ordered(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("statement", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))


def depth(rows: DataFrame, key: str, opens: Column, closes: Column) -> DataFrame:
    """Adds ``depth`` (blocks open after the line) and ``opener`` (the line of the last opener)."""
    upto = ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = opens.cast("int") - closes.cast("int")
    return rows.withColumn("depth", F.sum(step).over(upto)).withColumn("opener", F.last(F.when(opens, F.col("n")), ignorenulls=True).over(upto))


def block_above(rows: DataFrame, key: str, comment: Column) -> DataFrame:
    """Adds ``island``: runs of comment lines without a gap have one number (gaps and islands)."""
    start = comment & ~F.coalesce(F.lag(comment).over(ordered(key)), F.lit(False))
    upto = ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("island", F.when(comment, F.sum(start.cast("int")).over(upto)))


def nearest_before(rows: DataFrame, key: str, mark: Column, within: int) -> DataFrame:
    """Adds ``marked``: the nearest marked line before, if it is close enough."""
    before = ordered(key).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(mark, F.col("n")), ignorenulls=True).over(before)
    return rows.withColumn("marked", F.when(F.col("n") - last <= within, last))


def breadcrumbs(rows: DataFrame, key: str, level: Column, title: Column, levels: int = 4) -> DataFrame:
    """Adds ``crumb``: the titles above, level by level; a heading ends those of its own and deeper levels."""
    upto = ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, names = rows.withColumn("_level", level).withColumn("_title", title), []
    for k in range(1, levels + 1):
        reset = F.last(F.when(F.col("_level") <= k, F.struct(F.col("_level").alias("l"), F.col("_title").alias("t"))), ignorenulls=True).over(upto)
        out = out.withColumn(f"_h{k}", F.when(reset["l"] == k, reset["t"]))
        names.append(F.col(f"_h{k}"))
    return out.withColumn("crumb", F.concat_ws(" > ", *names)).drop("_level", "_title", *[f"_h{k}" for k in range(1, levels + 1)])
