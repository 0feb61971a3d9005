"""Scalar functions on text, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query's terms leave out.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "what",
    "when", "where", "which", "who", "why", "with",
]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def shorten(text: Column, n: int) -> Column:
    """White space collapsed, cut to n characters with an ellipsis as the last."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n - 1)), F.lit("…"))).otherwise(flat)


def first_sentence(text: Column) -> Column:
    """Shortest start that ends in a full stop, question or exclamation mark before a blank or the end; else all."""
    found = F.regexp_extract(text, r"^(.+?[.!?])(\s|$)", 1)
    return F.when(found == "", text).otherwise(found)


def prose(text: Column, tag: str, dropped: str) -> Column:
    """Lines with the tag, without it, joined by blanks; those that match ``dropped`` are left out."""
    kept = F.filter(F.split(text, "\n"), lambda x: x.startswith(tag))
    bare = F.transform(kept, lambda x: F.trim(F.substr(x, F.lit(len(tag) + 1), F.length(x))))
    return F.array_join(F.filter(bare, lambda x: (x != "") & ~x.rlike(dropped)), " ")


def squeezed(header: Column, text: Column) -> Column:
    """What is embedded: header, newline, text; runs of blanks and tabs are one blank."""
    return F.regexp_replace(F.concat(header, F.lit("\n"), text), "[ \\t]+", " ")


def visible(text: Column, n: int = 1000) -> Column:
    """What a model sees of a text: its first n characters."""
    return F.left(text, F.lit(n))


def content_key(model: Column, text: Column) -> Column:
    """SHA-1 of model and text."""
    return F.sha1(F.concat(model, F.lit("|"), text))


def index_title(header: Column, names: Column) -> Column:
    """The header without its line of used names, and the declared names."""
    lines = F.filter(F.split(header, "\n"), lambda x: ~x.startswith("Uses:"))
    return F.trim(F.concat(F.array_join(lines, "\n"), F.lit(" "), F.array_join(names, " ")))


def query_terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Terms of a query in order, without stop words; different cases are different terms."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    stops = F.array(*[F.lit(x) for x in stop_words])
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stops, F.lower(w))))


def identifiers(text: Column) -> Column:
    """Distinct identifiers in order of appearance."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Za-z]")))


def prefixed_identifiers(text: Column) -> Column:
    """Identifiers with an underscore inside, in order."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]\w*_\w+"), F.lit(0))


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def unquoted(text: Column) -> Column:
    """Trimmed, without quotes around it."""
    return F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", "")


def as_number(text: Column) -> Column:
    """The number that a text is; null if it is none."""
    return F.when(is_number(text), text.try_cast("double"))


def compare(left: Column, op: Column, right: Column) -> Column:
    """Comparison of two values: as numbers if both are, else equality without regard to case, else unknown."""
    a, b = unquoted(left), unquoted(right)
    x, y = as_number(a), as_number(b)
    p, q = F.lower(a), F.lower(b)
    both = x.isNotNull() & y.isNotNull()
    number = F.when(op == "eq", x == y).when(op == "ne", x != y).when(op == "lt", x < y).when(op == "le", x <= y).when(op == "gt", x > y).when(op == "ge", x >= y)
    word = F.when(op == "eq", p == q).when(op == "ne", p != q)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).when(both, number).otherwise(word)


def module_matches(module: Column, wanted: Column) -> Column:
    """Is the module (``NN_name``) meant by a number, a name or the whole, in any case?"""
    m, w = F.lower(module), F.lower(F.trim(wanted))
    number, name = F.substring_index(m, "_", 1), F.regexp_replace(m, "^[^_]*_", "")
    return (m == w) | (name == w) | (number == w) | (w.rlike(r"^\d$") & (number == F.lpad(w, 2, "0")))


def normal_value(text: Column) -> Column:
    """Numbers rounded to nine digits, percentages as fractions, else lower case without marks around it."""
    bare = F.regexp_replace(F.trim(text), "^[\"'`.,;:()]+|[\"'`.,;:()]+$", "")
    part = F.regexp_replace(bare, r"\s*%$", "")
    value = F.when(is_number(part), part.try_cast("double"))
    number = F.round(F.when(bare.endswith("%"), value / 100).otherwise(value), 9)
    return F.when(number.isNotNull(), number.cast("string")).otherwise(F.lower(bare))


def same_value(stated: Column, actual: Column) -> Column:
    """Equal as numbers, as percentage, as change against one, or one text the start of the other."""
    s, a = stated.try_cast("double"), actual.try_cast("double")
    numeric = F.exists(F.array(a, a / 100, a - 1, a * 100), lambda x: F.abs(x - s) < 1e-9)
    return F.when(s.isNotNull() & a.isNotNull(), numeric).otherwise(actual.startswith(stated) | stated.startswith(actual))


def path_part(path: Column, part: str) -> Column:
    """``module``, ``realization`` or ``phase`` of a source path, null where there is none."""
    patterns = {
        "module": r"^(?:modules/(\d+_[^/]+)|(core)/)",
        "realization": r"^modules/\d+_[^/]+/([^/.]+)/",
        "phase": r"^(?:modules/\d+_[^/]+/[^/.]+|core)/([^/.]+)\.[^/]*$",
    }
    found = F.regexp_extract(path, patterns[part], 1)
    if part == "module":
        found = F.concat(found, F.regexp_extract(path, patterns[part], 2))
    return F.nullif(found, F.lit(""))


def phase_class(phase: Column, role: Column) -> Column:
    return F.when(role == "equation", "equation").when(phase.isin("presolve", "postsolve", "loop"), "between solves").otherwise("setup")


def cell(text: Column, n: int = 140) -> Column:
    """A cell of a Markdown table."""
    return F.left(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(n))


def equation_domain(text: Column) -> Column:
    """What stands before the dots of an equation, without comments."""
    return F.trim(F.substring_index(F.regexp_replace(text, r"(?m)^\*.*$\n?", ""), "..", 1))


def equation_condition(domain: Column) -> Column:
    """What stands behind the first dollar of a domain."""
    at = F.instr(domain, "$")
    return F.when(at > 0, F.trim(F.substr(domain, at + 1, F.length(domain))))
