"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text is a sequence of words; each run of K words has a hash, and of every W runs in a
row the smallest hash is kept as a fingerprint.  Two texts that share K + W - 1 = WINDOW
words in a row share the fingerprint of that stretch, so the join of fingerprints finds
every shared window.  Hits are extended to the whole windows around a fingerprint, whose
words are compared through their 64-bit hashes.  Items of fewer words than WINDOW are one
window each, looked up in the same pass where their first words stand.

Defined results: null and empty texts have no words and are clean; a word counts as hit
once however many windows hold it; repeated rows get the same result each; rows with a
null item_id count as the item named by the empty string; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import bounded_broadcast

#: Words of a text whose capitals are not folded yet: folding A-Z moves no boundary.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
WINDOW, K = 10, 5
W = WINDOW - K + 1
#: First words of short items are listed in the plan up to this number; beyond it every place of a text counts as a beginning.
FIRST_WORDS = 10_000
ROW = ["row_a", "row_b"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, everything else as it is; only words with other capitals take the slow way."""
    low = F.lower(word)
    return F.when((F.length(word) == F.octet_length(word)) | (low == word), low).otherwise(F.translate(word, _UPPER, _LOWER))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words in order; a null text has none."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(ascii_lower(w)))


def _upto(last: Column) -> Column:
    """0 to last, or nothing."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _runs(own: DataFrame) -> DataFrame:
    """Adds ``runs``: stretches of windows with one fingerprint (print, first window, words around).

    ``own`` has ``h``, the word hashes, at least WINDOW of them.
    """
    mix = lambda *x: F.xxhash64(*x)
    word = lambda i, d: F.get("h", i + d)
    grams = F.transform(_upto(F.size("h") - K), lambda i: mix(mix(mix(word(i, 0), word(i, 1)), mix(word(i, 2), word(i, 3))), word(i, 4)))
    prints = F.transform(_upto(F.size("h") - WINDOW), lambda j: F.least(*[F.get("g", j + d) for d in range(W)]))
    starts = F.filter(_upto(F.size("h") - WINDOW), lambda j: (j == 0) | (F.get("p", j) != F.get("p", j - 1)))
    run = F.transform(
        "s",
        lambda j, k: F.struct(
            F.get("p", j).alias("print"), j.alias("first"),
            F.slice("h", j + 1, F.coalesce(F.get("s", k + 1), F.size("p")) - j + WINDOW - 1).alias("words"),
        ),
    )
    return own.withColumn("g", grams).withColumn("p", prints).withColumn("s", starts).withColumn("runs", run).drop("g", "p", "s")


def _windows(first: Column, words: Column, length: int) -> Column:
    """(start, hash, words) of every window of so many words."""
    return F.transform(
        _upto(F.size(words) - length),
        lambda d: F.struct((first + d).alias("start"), F.xxhash64(F.slice(words, d + 1, length)).alias("window"), F.slice(words, d + 1, length).alias("words")),
    )


def _prints(hashed: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``h`` and ``prints``, the fingerprints of the texts with at least WINDOW words (none of others).

    ``hashed`` has the keys and ``h``.  Sliding hashes and minima over K = 5 and W = 6
    places are put together from those over 1, 2 and 4, a projection each, so that each is
    computed once; places past the end, where an operand is missing, are cut off at last.
    """
    shift = lambda a, d: F.slice(a, F.lit(d + 1), F.greatest(F.size(a) - d, F.lit(0)))
    hash2 = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    least = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
    two = hashed.select(*keys, "h", hash2("h", shift("h", 1)).alias("two"))
    five = two.select(*keys, "h", hash2(hash2("two", shift("two", 2)), shift("h", 4)).alias("five"))
    pair = five.select(*keys, "h", least("five", shift("five", 1)).alias("pair"))
    quad = pair.select(*keys, "h", "pair", least("pair", shift("pair", 2)).alias("quad"))
    six = F.slice(least("quad", shift("pair", 4)), F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(0)))
    return quad.select(*keys, "h", six.alias("prints"))


def _short_windows(firsts: list[int] | None, lengths: list[int]) -> Column:
    """(start, length, window) of the places of ``h`` where a short item may begin: a hash for each length.

    ``firsts`` are the hashes of the first words of the short items, None if they are too many to list.
    """
    none = F.array().cast("array<struct<start:int,length:int,window:bigint>>")
    if not lengths:
        return none
    places = _upto(F.size("h") - 1)
    if firsts is not None:
        places = F.filter(places, lambda i: F.get("h", i).isin(firsts))
    return F.flatten(F.transform(places, lambda i: F.array(*[
        F.struct(i.alias("start"), F.lit(n).alias("length"), F.xxhash64(F.lit(n), F.slice("h", i + 1, n)).alias("window")) for n in lengths
    ])))


def find_hits(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, start, length and item_id of every occurrence of an item's window in a document.

    ``docs`` has the keys and the text, ``items`` has item_id and ``h``, the word hashes.
    One pass over the documents lays out their fingerprints, and the places where the first
    word of a short item stands, and singles out the documents that share any; only in those
    are the stretches of windows around shared fingerprints laid out and compared.  Item
    windows are stored once; they are broadcast if few, and joined by shuffling if not.
    Arrays are laid out with outer explodes, as for an inner one the optimizer computes them
    twice.
    """
    held = materialize(items.filter(F.size("h") > 0), "items")
    long_items, short = held.filter(F.size("h") >= WINDOW), held.filter(F.size("h") < WINDOW)
    prints = materialize(_prints(long_items, "item_id").select(F.explode_outer("prints").alias("print")).distinct(), "prints")
    windows = long_items.select("item_id", F.explode_outer(_windows(F.lit(0), F.col("h"), WINDOW)).alias("w"))
    whole = materialize(windows.select("item_id", "w.window", F.col("w.words").alias("held")).distinct(), "windows")
    size = F.size("h")
    keyed = materialize(short.select("item_id", size.alias("length"), F.xxhash64(size, "h").alias("window"), F.col("h").alias("held")).distinct(), "short")
    lengths = sorted(n for (n,) in keyed.select("length").distinct().collect())  # fewer than WINDOW values
    firsts = [x for (x,) in keyed.select(F.get("held", 0)).distinct().limit(FIRST_WORDS + 1).collect()]
    begins = _short_windows(firsts if len(firsts) <= FIRST_WORDS else None, lengths)
    needles = materialize(prints.select(F.col("print").alias("needle")).unionByName(keyed.select(F.col("window").alias("needle"))).distinct(), "needles")

    hashed = _prints(docs.select(*keys, word_hashes(F.col("text")).alias("h")), *keys)
    offered = F.array_distinct(F.concat("prints", F.transform(begins, lambda x: x["window"])))
    near = hashed.select(*keys, F.explode_outer(offered).alias("needle")).join(bounded_broadcast(needles), "needle", "left_semi").select(*keys).distinct()
    again = docs.join(bounded_broadcast(materialize(near, "near")), keys, "left_semi").select(*keys, word_hashes(F.col("text")).alias("h"))
    runs = _runs(again.filter(F.size("h") >= WINDOW)).select(*keys, F.explode_outer("runs").alias("r"))
    around = runs.select(*keys, "r.print", "r.first", "r.words").join(bounded_broadcast(prints), "print", "left_semi")
    found = around.select(*keys, F.explode_outer(_windows(F.col("first"), F.col("words"), WINDOW)).alias("w")).select(*keys, "w.*")
    hits = found.join(bounded_broadcast(whole), "window").filter("words = held").select(*keys, "start", F.lit(WINDOW).alias("length"), "item_id")
    begun = again.select(*keys, "h", F.explode_outer(begins).alias("w")).select(*keys, "w.*", F.slice("h", F.col("w.start") + 1, F.col("w.length")).alias("words"))
    begun = begun.join(bounded_broadcast(keyed), ["length", "window"]).filter("words = held")
    return hits.unionByName(begun.select(*keys, "start", "length", "item_id"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row, its id and text, and its 128-bit hash, which stands for it in joins."""
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.withColumns({ROW[0]: F.xxhash64("doc_id", "text"), ROW[1]: F.xxhash64(F.lit(1), "doc_id", "text")})


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), word_hashes(F.col(item_text_col)).alias("h"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """id, n_words, n_hit, hit_words (their places), items and contaminated, for every row."""
    own = _keyed(docs, id_col, text_col)
    hits = find_hits(own.select(*ROW, "text"), _items(benchmark, item_col, item_text_col), ROW)
    places = F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    by_row = hits.groupBy(*ROW).agg(F.collect_set(F.struct("start", "length")).alias("at"), F.array_sort(F.collect_set("item_id")).alias("items"))
    found = by_row.select(*ROW, F.array_sort(places).alias("hit_words"), "items")
    counted = own.select("doc_id", *ROW, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_words"))
    return counted.join(found, ROW, "left").select(
        F.col("doc_id").alias(id_col), "n_words",
        F.coalesce(F.size(F.coalesce("hit_words", F.array().cast("array<int>"))), F.lit(0)).cast("bigint").alias("n_hit"),
        "hit_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("items").isNotNull().alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, unchanged."""
    own = _keyed(docs, id_col, text_col)
    leaks = materialize(find_hits(own.select(*ROW, "text"), _items(benchmark, item_col, item_text_col), ROW).select(*ROW).distinct(), "leaks")
    return own.join(bounded_broadcast(leaks), ROW, "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM doc_windows d JOIN item_windows b ON d.win = b.win AND d.n = b.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLES = {"op8_decontaminate": ORACLE}
