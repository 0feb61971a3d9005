"""Line deduplication over a deletion neighbourhood, with DataFrame functions only.

A line, trimmed of blanks, is removed if an equal line stands earlier in the corpus, or
one within MAX_EDITS = 1 edit of it.  Lines of at least MIN_WORDS words are compared word
by word (what single blanks separate), shorter ones of at least MIN_CHARS characters
character by character; lines that are shorter still, for equality only.  Lines of the
two kinds are not compared with each other.  The order of the corpus is that of (doc_id,
line number, hash of the text).

1. Equal lines meet by their 128-bit hash; the earliest stays.
2. Two different lines within one edit share the units before or after the edit, so at
   least one half.  Only lines that share a half with another line go on; this drops no
   pair.
3. Of those, every variant with one unit deleted (in the half that may differ) is emitted
   as a hashed key together with the place of the deletion (a replaced unit), and without
   it, beside the key of the whole line (an added or missing unit).  Lines that share a key
   with the place are within one edit; without it, the whole line and each variant are, but
   not two variants, as these may lack different units.  Keys without such a pair are
   dropped.  The earliest variant and the whole line of each key are all that its members
   need: no pairs are formed.
4. The earliest partner is looked up and the edit distance verified on the units, against
   equal hashes of different lines.

Time and memory are linear in the length of a line.

Defined results: null and empty texts have no line to compare and stay as they are; of
rows that are equal in doc_id and text one is kept; texts that share a doc_id are told
apart by their hash; columns other than n_lines and n_removed are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceframe.functions.scans import running
from traceframe.plans.scratch import materialize
from traceframe.plans.sizing import bounded_broadcast

MIN_WORDS, MIN_CHARS = 5, 10
#: Keys of a variant with the place of its gap, of a variant without it, and of a whole line; the kind is in the two lowest bits.
REPLACED, MISSING, WHOLE = 0, 1, 2
#: The two halves of the 128-bit hashes of a line and of a text.
LINE, TEXT = ["line_a", "line_b"], ["text_a", "text_b"]


def _hashes(value: Column, names: list[str]) -> list[Column]:
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, line_no, the trimmed line, whether it is compared by words, and its units; no empty lines."""
    lines = docs.filter("text is not null").select("doc_id", *_hashes(F.col("text"), TEXT), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    line = lines.select("doc_id", *TEXT, "line_no", F.trim("raw").alias("line")).filter("line <> ''")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return line.withColumn("by_words", words >= MIN_WORDS).withColumn("n", F.when(F.col("by_words"), words).otherwise(F.length("line")))


def _near() -> Column:
    """Is the line compared for edits at all?"""
    return F.col("by_words") | (F.col("n") >= MIN_CHARS)


def _halves() -> Column:
    """(last, half) hashes of the first and last p units, for both p that a partner within one edit can mean."""
    keys = []
    for p in (F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")):
        first = F.when(F.col("by_words"), F.call_function("substring_index", F.col("line"), F.lit(" "), p)).otherwise(F.left("line", p))
        last = F.when(F.col("by_words"), F.call_function("substring_index", F.col("line"), F.lit(" "), -p)).otherwise(F.right("line", p))
        keys.append(F.struct(F.lit(False).alias("last"), F.xxhash64(F.lit("first"), "by_words", p, first).alias("half")))
        keys.append(F.struct(F.lit(True).alias("last"), F.xxhash64(F.lit("last"), "by_words", p, last).alias("half")))
    return F.array_distinct(F.array(*keys))


def _units() -> Column:
    return F.when(F.col("by_words"), F.split("line", " ")).otherwise(F.split("line", ""))


def _variants(lines: DataFrame) -> DataFrame:
    """line, place, key and kind of key of the deletion variants of each line, and of the line itself.

    ``lines`` has the units, and whether the line shares a first or a last half: a line that
    shares its first units only has the edit behind them.  A sequence of units is hashed as
    the exclusive-or of the hashes of (unit, place), so a variant takes two lookups: the
    units before the gap at their places and those behind it one place further left.
    """
    n = F.size("units")
    half = F.floor((n - 1) / 2).cast("int")
    xor = lambda a, h: a.bitwiseXOR(h)
    at = lambda shift: lambda u, j: F.xxhash64(u, j - shift, "by_words")
    gaps = F.sequence(F.when(F.col("by_last"), 0).otherwise(half), F.when(F.col("by_first"), n - 1).otherwise(n - 1 - half))
    rest = F.transform(gaps, lambda i: F.struct(i.alias("i"), F.get("before", i).bitwiseXOR(F.get("behind", n - 1 - i)).alias("h")))
    of = lambda key, kind: key.bitwiseAND(F.lit(-4).cast("bigint")).bitwiseOR(F.lit(kind).cast("bigint"))
    pair = F.transform("rest", lambda x: F.array(of(F.xxhash64(F.lit("replaced"), x["i"], x["h"]), REPLACED), of(x["h"], MISSING)))
    keyed = (
        lines.withColumn("before", running(F.transform("units", at(0)), F.lit(0).cast("bigint"), xor))
        .withColumn("behind", running(F.reverse(F.transform("units", at(1))), F.lit(0).cast("bigint"), xor))
        .withColumn("rest", rest)
    )
    whole = F.array(of(F.element_at("before", -1), WHOLE))
    every = keyed.select(*LINE, "place", F.explode_outer(F.array_distinct(F.concat(F.flatten(pair), whole))).alias("k"))
    return every.select(*LINE, "place", F.col("k").bitwiseAND(F.lit(-4).cast("bigint")).alias("key"), F.col("k").bitwiseAND(F.lit(3).cast("bigint")).alias("kind"))


def within_one_edit(a: Column, b: Column) -> Column:
    """Do two arrays differ by at most one inserted, deleted or replaced element?"""
    shorter, longer = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.when(shorter > 0, F.transform(F.sequence(F.lit(0), shorter - 1), lambda i: F.get(a, i) == F.get(b, i))).otherwise(F.array().cast("array<boolean>"))
    back = F.when(shorter > 0, F.transform(F.sequence(F.lit(1), shorter), lambda i: F.get(a, F.size(a) - i) == F.get(b, F.size(b) - i))).otherwise(F.array().cast("array<boolean>"))
    run = lambda flags: F.coalesce(F.nullif(F.array_position(flags, F.lit(False)), F.lit(0)) - 1, shorter)
    return (longer - shorter <= 1) & (run(same) + run(back) >= longer - 1)


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, line_no and kind (``exact`` or ``near``) of the lines to remove.

    ``docs`` has doc_id and text, and no row twice.
    """
    place = F.struct("doc_id", "line_no", *TEXT)
    halves = F.when(_near(), _halves())
    lines = materialize(_lines(docs).select("doc_id", *TEXT, "line_no", *_hashes(F.col("line"), LINE), halves.alias("halves")), "lines")
    known = lines.groupBy(*LINE).agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"))

    halves = lines.select(*LINE, F.explode("halves").alias("h")).select(*LINE, "h.last", "h.half")
    shared = halves.groupBy("half").agg(F.min("line_a").alias("least"), F.max("line_a").alias("most")).filter("least <> most").select("half")
    sides = halves.join(bounded_broadcast(materialize(shared, "shared")), "half", "left_semi").groupBy(*LINE).agg(F.bool_or(~F.col("last")).alias("by_first"), F.bool_or("last").alias("by_last"))
    near_hash = materialize(sides, "near")

    # The units of the lines that go on, from their earliest place.
    again = _lines(docs).filter(_near()).select(place.alias("place"), *_hashes(F.col("line"), LINE), "line", "by_words").join(bounded_broadcast(near_hash), LINE)
    # Stored as units: an expression would be worked out again inside every lambda below.
    earliest_line = again.groupBy(*LINE, "by_words", "by_first", "by_last").agg(F.min_by("line", "place").alias("line"), F.min("place").alias("place"))
    candidates = materialize(earliest_line.withColumn("units", _units()).drop("line"), "candidates")
    variants = _variants(candidates)
    held = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    met = materialize(held.filter((F.col("n") > 1) & ((F.col("high") == REPLACED) | (F.col("low") < F.col("high")))).select("key"), "keys")
    meeting = materialize(variants.join(bounded_broadcast(met), "key", "left_semi"), "meeting")
    own, is_whole = F.struct("place", *LINE), F.col("kind") == WHOLE
    ends = meeting.groupBy("key").agg(F.min(F.when(~is_whole, own)).alias("variant"), F.min(F.when(is_whole, own)).alias("whole"))
    first = F.when(F.col("kind") == MISSING, F.col("whole")).otherwise(F.col("variant"))
    partner = meeting.join(ends, "key").withColumn("first", first).filter("first.place < place")
    earliest = partner.groupBy(*LINE).agg(F.min("first").alias("first")).select(*LINE, F.col("first.place").alias("near"), F.col("first.line_a").alias("of_a"), F.col("first.line_b").alias("of_b"))
    ours = candidates.select(*LINE, "by_words", F.col("units").alias("a"))
    theirs = candidates.select(F.col("line_a").alias("of_a"), F.col("line_b").alias("of_b"), F.col("by_words").alias("other_by_words"), F.col("units").alias("b"))
    checked = earliest.join(ours, LINE).join(theirs, ["of_a", "of_b"]).filter((F.col("by_words") == F.col("other_by_words")) & within_one_edit(F.col("a"), F.col("b")))
    near = materialize(checked.select(*LINE, "near"), "partners")

    repeated = known.join(near, LINE, "left").filter("copies > 1 or near is not null").select(*LINE, F.col("place").alias("exact"), "near")
    marked = lines.select("doc_id", *TEXT, "line_no", *LINE).join(bounded_broadcast(materialize(repeated, "repeated")), LINE)
    kind = F.when(F.col("exact") < place, "exact").when(F.col("near") < place, "near")
    return marked.select("doc_id", *TEXT, "line_no", kind.alias("kind")).filter("kind is not null")


def _one_of_equal_rows(own: DataFrame) -> DataFrame:
    """``own`` (doc_id, text, row, hash of the text) with rows of equal id and text once; only those are shuffled."""
    keys = ["doc_id", *TEXT]
    counted = own.filter("text <> ''").groupBy(*keys).count().filter("count > 1")
    repeated = materialize(counted.select(*[F.col(k).alias(f"r_{k}") for k in keys]), "repeated_rows")
    if repeated.isEmpty():
        return own
    same = (F.col("text") != "") & F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("text_a") == F.col("r_text_a")) & (F.col("text_b") == F.col("r_text_b"))
    found = own.join(bounded_broadcast(repeated), same, "left_semi").groupBy(*keys).agg(F.first("text").alias("text"), F.first("row").alias("row"))
    return own.join(bounded_broadcast(repeated), same, "left_anti").unionByName(found)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines cut out of the text, and n_lines and n_removed beside it."""
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_hashes(F.col(text_col), TEXT))
    own = _one_of_equal_rows(own)
    marked = find_repeats(own.select("doc_id", "text")).groupBy("doc_id", *TEXT).agg(F.collect_set("line_no").alias("cut"))
    cut = marked.select(F.col("doc_id").alias("c_doc_id"), F.col("text_a").alias("c_text_a"), F.col("text_b").alias("c_text_b"), "cut")
    same = F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("text_a") == F.col("c_text_a")) & (F.col("text_b") == F.col("c_text_b"))
    joined = own.join(cut, same, "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "cut")
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(F.array_sort(kept), lambda i: F.get("lines", i)), "\n"))
    return joined.select(
        *[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", F.col("n_lines").cast("bigint"), F.col("n_removed").cast("bigint"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = """
WITH doc AS (SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents) WHERE copy = 1 OR text = '' OR text IS NULL),
line AS (
  SELECT doc_id, i - 1 AS line_no, trim(string_split(text, chr(10))[i], ' ') AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM doc WHERE text IS NOT NULL)),
part AS (
  SELECT *, CASE WHEN by_words THEN words ELSE string_split(line, '') END AS w, by_words OR length(line) >= 10 AS near
  FROM (SELECT *, string_split(line, ' ') AS words, len(string_split(line, ' ')) >= 5 AS by_words FROM line WHERE line <> '')),
uniq AS (SELECT line, by_words, near, any_value(w) AS w, min({'d': doc_id, 'l': line_no}) AS place FROM part GROUP BY line, by_words, near),
variant AS (
  SELECT line, by_words, place, i, CASE WHEN by_words THEN array_to_string(v, ' ') ELSE array_to_string(v, '') END AS rest
  FROM (SELECT *, list_concat(w[1 : i - 1], w[i + 1 :]) AS v FROM (SELECT line, by_words, w, place, unnest(generate_series(1, len(w))) AS i FROM uniq WHERE near))),
replaced AS (
  SELECT v.line, min(f.place) AS near FROM variant v
  JOIN (SELECT by_words, i, rest, min(place) AS place FROM variant GROUP BY by_words, i, rest HAVING count(*) > 1) f ON v.by_words = f.by_words AND v.i = f.i AND v.rest = f.rest AND f.place < v.place GROUP BY v.line),
missing AS (
  SELECT line, min(near) AS near FROM (
    SELECT v.line, u.place AS near FROM variant v JOIN uniq u ON v.rest = u.line AND v.by_words = u.by_words WHERE u.near AND u.place < v.place
    UNION ALL SELECT u.line, v.place FROM variant v JOIN uniq u ON v.rest = u.line AND v.by_words = u.by_words WHERE u.near AND v.place < u.place) GROUP BY line),
near AS (SELECT line, min(near) AS near FROM (SELECT * FROM replaced UNION ALL SELECT * FROM missing) GROUP BY line),
gone AS (
  SELECT p.doc_id, p.line_no FROM part p JOIN uniq u ON p.line = u.line LEFT JOIN near n ON n.line = p.line
  WHERE u.place < {'d': p.doc_id, 'l': p.line_no} OR coalesce(n.near < {'d': p.doc_id, 'l': p.line_no}, false)),
cut AS (SELECT doc_id, list(line_no) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END, '')) AS text_sha256
FROM doc d LEFT JOIN cut USING (doc_id)
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLES = {"op7_line_dedup": ORACLE}
