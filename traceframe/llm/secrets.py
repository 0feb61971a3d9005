"""Secrets in text: three patterns and a battery of randomness tests, with DataFrame functions only.

Patterns give the base spans (``assign``, ``access``, ``hex``).  The battery looks at every
other run of at least MIN_TOKEN token characters that fits an encoding (hex, base32,
base36, base62, base64, base64url), inferred from its characters.  UUIDs, which are random
but no secret, are left out.  Three tests are made over the encoding's alphabet:

* chi-squared: how far the counts of the symbols are from uniform, per character;
* runs: how far the share of changes between the symbols that are frequent in text and
  the other half of the alphabet is from 1/2;
* serial correlation of neighbouring symbols, in the alphabet's own order.

Under randomness each of the three has a known mean and spread, which shrinks with the
length.  Under the background (names, paths, versions, numbers) it lies off by an effect
that depends on the encoding and varies between tokens (BACKGROUND, fitted on made-up
identifiers).  The logarithms of the three likelihood ratios are summed up.  The
background reaches a sum x with a probability of about ``tail * exp(-x)``: the token's
p-value.  Longer tokens reach higher sums.  The p-values are weighed by length (mean
weight 1), and a Benjamini-Hochberg step at level FDR over all tokens of the table keeps
the spans of kind ``random``.  The step works on a histogram of BINS bins, rounded to the
safe side, so only counts are gathered.

Defined results: null and empty texts have no span; spans count code points, ends are
exclusive; rows repeated are scanned once each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceframe.functions.scans import let, running
from traceframe.plans.scratch import materialize

# The patterns of the base spans, in order, with the group whose length counts.
_KEYWORD, _GIVEN = r"(password|passwd|secret|token|api_?key)", r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"(?i:{_KEYWORD}){_GIVEN}([A-Za-z0-9+/_.=-]+)"
ASSIGN_LENGTH = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]

MIN_TOKEN = 20
#: A whole run of token characters that is no keyword with a value behind it.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?!(?<=(?i:%s))%s[A-Za-z0-9+/_.=-])" % (MIN_TOKEN, _KEYWORD.replace("(", "(?:"), _GIVEN)
#: Assignments are passed over as the base pattern passes over them, so tokens (group 3) never overlap one.
OUTSIDE = f"{ASSIGN}|({TOKEN})"
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"  # letters from frequent to rare
#: Encodings in the order they are tried: name, pattern of the whole token, alphabet.
ENCODINGS = [
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", _DIGITS + _LOWER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", _DIGITS + "+/" + _UPPER + _LOWER),
    ("base64url", "^[0-9A-Za-z_-]+$", _DIGITS + "-_" + _UPPER + _LOWER),
]
#: By encoding: mean and spread between tokens of the three effects of the background, and how often it reaches a sum of 0.
BACKGROUND = {
    "hex": (1.2, 0.8, 0.25, 0.12, 0.30, 0.20, 0.10),
    "base32": (0.9, 0.4, 0.22, 0.08, 0.15, 0.10, 0.04),
    "base36": (1.0, 0.4, 0.22, 0.08, 0.15, 0.10, 0.02),
    "base62": (1.9, 0.7, 0.25, 0.08, 0.20, 0.12, 0.02),
    "base64": (2.6, 0.7, 0.28, 0.06, 0.20, 0.12, 0.005),
    "base64url": (2.8, 1.2, 0.30, 0.10, 0.20, 0.15, 0.02),
}
#: By encoding: the half of its alphabet that text uses most, letters of lower case first.
FREQUENT = {name: "".join(c for c in _FREQUENT + _FREQUENT.upper() + alphabet[::-1] if c in alphabet)[: len(alphabet) // 2] for name, _, alphabet in ENCODINGS}
FDR = 0.05
BINS, BIN_STEP = 4096, 64.0
_SPAN = "array<struct<start:int,kind:int,end:int,token:string>>"


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """(start, kind, end, token) of each match: what lies between matches gives the places."""

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        steps = F.flatten(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.array(F.length(b), F.length(m))))
        return let(running(steps, F.lit(0), lambda a, x: a + x), lambda at: F.zip_with(
            found, F.transform(found, lambda _, i: F.get(at, 2 * i + 1)),
            lambda m, s: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(m)).alias("end"), m.alias("token")),
        ))

    span = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if keep is not None:
        span = F.transform(F.filter(F.arrays_zip(span.alias("s"), keep.alias("k")), lambda x: x["k"]), lambda x: x["s"])
    return F.when(text.rlike(pattern), span).otherwise(F.array().cast(_SPAN))


def effects(token: Column, alphabet: Column, frequent: Column) -> Column:
    """What the three tests find in a token: unevenness, runs and serial correlation, each 0 for perfect randomness."""
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    counts = F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(token, c, F.lit(""))))
    chi = k / n * F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) - n
    uneven = F.abs(chi - (k - 1)) / n

    def neighbours(v: Column) -> Column:
        pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("x"), F.slice(v, F.lit(2), F.size(v) - 1).alias("y"))
        changes = F.size(F.filter(pairs, lambda p: p["x"]["often"] != p["y"]["often"]))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x["at"]) / n
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x["at"] - mean) * (x["at"] - mean))
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["x"]["at"] - mean) * (p["y"]["at"] - mean))
        serial = F.when(square > 0, F.abs(lagged / square + 1 / n)).otherwise(1.0)
        return F.struct(uneven.alias("uneven"), F.abs(changes / (n - 1) - 0.5).alias("runs"), serial.alias("serial"))

    placed = lambda c: F.struct(F.position(c, alphabet).cast("double").alias("at"), (F.position(c, frequent) > 0).alias("often"))
    return let(F.transform(F.split(token, ""), placed), neighbours)


def _log_ratio(effect: Column, spread: Column, mean: Column, background: Column) -> Column:
    """Logarithm of the likelihood ratio of two folded normal distributions, around 0 and around ``mean``."""
    chance = F.log(2 / spread) - (effect / spread) * (effect / spread) / 2
    near, far = ((effect - mean) / background) * ((effect - mean) / background) / -2, ((effect + mean) / background) * ((effect + mean) / background) / -2
    return chance - (near + F.log1p(F.exp(far - near)) - F.log(background))


def p_value(token: Column, encoding: Column) -> Column:
    """How often the background of the encoding looks as random as this token."""
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), encoding)
    alphabet = pick([a for _, _, a in ENCODINGS])
    value = lambda i: pick([BACKGROUND[name][i] for name, _, _ in ENCODINGS])
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    chi, change, lag = F.sqrt(2 * (k - 1) * (n - 1) / n) / n, F.sqrt(0.25 / (n - 1)), 1 / F.sqrt(n)
    wide = F.sqrt((2 * (k - 1) + 4 * n * value(0)) / (n * n) + value(1) * value(1))
    with_spread = lambda s, i: F.sqrt(s * s + value(i) * value(i))

    def combined(e: Column) -> Column:
        total = (
            _log_ratio(e["uneven"], chi, value(0), wide)
            + _log_ratio(e["runs"], change, value(2), with_spread(change, 3))
            + _log_ratio(e["serial"], lag, value(4), with_spread(lag, 5))
        )
        return F.least(F.lit(1.0), value(6) * F.exp(-F.greatest(total, F.lit(-50.0))))

    return let(effects(token, alphabet, pick([FREQUENT[name] for name, _, _ in ENCODINGS])), combined)


def _encoding(token: Column) -> Column:
    """Place of the token's encoding, null if it fits none."""
    out = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(token.rlike(pattern), i).otherwise(out)
    return F.when(~token.rlike(UUID), out)


def _folded(token: Column, encoding: Column) -> Column:
    """Encodings of one case are tested in lower case."""
    return F.when(encoding.isin([i for i, e in enumerate(ENCODINGS) if e[0] in ("hex", "base36")]), F.lower(token)).otherwise(token)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base spans, and the tested tokens outside them with length, encoding and p-value."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    second = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.length(g) >= ASSIGN_LENGTH)
    base = F.concat(_spans(text, ASSIGN, 0, second), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    free = F.transform(F.regexp_extract_all(text, F.lit(OUTSIDE), F.lit(3)), lambda g: g != "")
    # Base spans of the other kinds consist of token characters, so one that meets a token lies inside it.
    tokens = F.filter(_spans(text, OUTSIDE, 3, free), lambda t: ~t["token"].rlike(f"{ACCESS}|{HEX}") & _encoding(t["token"]).isNotNull())
    own = docs.select(F.col(id_col).alias("id"), base.alias("base"), F.when(text.rlike(TOKEN), tokens).otherwise(F.array().cast(_SPAN)).alias("tokens"))
    tested = F.transform(
        "tokens",
        lambda t: let(_encoding(t["token"]), lambda e: F.struct(
            t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), (t["end"] - t["start"]).alias("n"),
            F.get(F.array(*[F.lit(name) for name, _, _ in ENCODINGS]), e).alias("encoding"), let(_folded(t["token"], e), lambda x: p_value(x, e)).alias("p"),
        )),
    )
    bare = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return own.select("id", bare.alias("base"), tested.alias("tested")).withColumnRenamed("id", id_col)


def threshold(tested: DataFrame) -> tuple[float, float]:
    """Mean length, and the largest weighed p-value that the step-up procedure accepts (-1 if none).

    ``tested`` has the array ``tested``; what reaches the driver is one row.
    """
    tokens = tested.select(F.explode_outer("tested").alias("t")).filter("t is not null").select("t.n", "t.p")
    mean = tokens.agg(F.avg("n").alias("mean")).first().mean or 1.0
    weighed = F.greatest(F.col("p") * mean / F.col("n"), F.lit(1e-60))
    place = F.least(F.floor(-F.log10(weighed) * BIN_STEP), F.lit(BINS - 1)).cast("int")
    counts = tokens.groupBy(place.alias("bin")).count()
    tail = Window.orderBy(F.desc("bin"))
    edge = F.pow(F.lit(10.0), -F.col("bin") / BIN_STEP)  # the largest value in the bin
    total = Window.partitionBy()
    ranked = counts.withColumn("below", F.sum("count").over(tail)).withColumn("all", F.sum("count").over(total))
    best = ranked.filter(edge <= FDR * F.col("below") / F.col("all")).agg(F.min("bin").alias("bin")).first().bin
    return mean, -1.0 if best is None else 10.0 ** (-best / BIN_STEP)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans`` (start, kind, end, encoding, weighed p; in order) of every row; the texts are read once."""
    found = materialize(candidates(docs, id_col=id_col, text_col=text_col), "candidates")
    mean, cut = threshold(found)
    value = lambda t: t["p"] * mean / t["n"]
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), none_s.alias("encoding"), none_d.alias("p")))
    extra = F.transform(
        F.filter("tested", lambda t: value(t) <= cut),
        lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), t["encoding"].alias("encoding"), value(t).alias("p")),
    )
    return found.select(id_col, F.array_sort(F.concat(base, extra)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, with commas between them."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op2_secrets": op2_secrets}
ORACLES: dict[str, str] = {}
