"""Scalar text functions as column expressions; they stay in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Common English words that an index may leave out (fixed values).
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def _composable() -> str:
    """A class of the letters and digits that have another compatibility form, by code point, found once from the character tables."""
    points = [p for p in range(0x80, 0x30000) if not 0xAC00 <= p <= 0xD7A3 and not 0xD800 <= p <= 0xDFFF]
    changed = [p for p in points if (n := unicodedata.normalize("NFKC", chr(p))) != chr(p) and any(c.isalnum() for c in n)]
    runs: list[list[int]] = []
    for p in changed:
        # what lies between two such letters may be tried in vain
        if runs and p - runs[-1][1] <= 64:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[\\p{M}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


COMPOSABLE = _composable()
#: Characters beyond Latin letters and common marks: a text without them has no other compatibility form (the ranges hold none).
_UNCOMMON = r"[^\x{0}-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{2009}-\x{205E}]"


def _has_other_form(column):
    return F.coalesce((F.octet_length(column) != F.length(column)) & F.rlike(column, F.lit(_UNCOMMON)) & F.rlike(column, F.lit(COMPOSABLE)), F.lit(False))


def compatible(column):
    """A text in compatibility form (NFKC), so that full-width letters, ligatures and the like meet their plain forms.

    There is no built-in for it: only texts with such characters are handed to Python, the others go as nulls."""
    return F.coalesce(compose(F.when(_has_other_form(column), column), F.lit("NFKC")), column)


def with_compatible(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the text column ``name`` in compatibility form; rows whose text has no other form never leave the JVM."""
    other = _has_other_form(F.col(name))
    return rows.filter(~other).unionByName(rows.filter(other).withColumn(name, compose(name, F.lit("NFKC"))))


def terms(column, stopwords: bool = False):
    """Search terms of a text: lower case, apostrophes dropped, runs of letters and digits, in order; of a text that may hold
    letters in compatibility forms, give :func:`compatible` of it."""
    found = F.regexp_extract_all(F.translate(F.lower(column), "'’", ""), F.lit(r"[a-z0-9\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOPWORDS)) if stopwords else found


@F.pandas_udf(StringType())
def compose(text: pd.Series, form: pd.Series) -> pd.Series:
    """Unicode normal form of a text (``NFC`` or ``NFKC``), which has no built-in."""
    return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, form)])


def shingles(column, width: int = 3):
    """Distinct runs of ``width`` words of a text's terms; a shorter text is one run."""
    words = terms(column)
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, width), " ")))


def jaccard(a, b):
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def cited_numbers(column):
    """Distinct source numbers that a text cites as ``[1]`` or ``[2, 3]``, ascending."""
    marks = F.regexp_extract_all(column, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("bigint"))))


def without_marks(column):
    """A text without its citation marks and the white space before them."""
    return F.trim(F.regexp_replace(column, r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""))


def question_key(column):
    """What makes two questions the same: case, white space and a closing question mark do not."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(column), r"\s+", " ")), r"[?\s]+$", "")


def snippet(column, length: int):
    """One line of at most ``length`` characters, the last an ellipsis where cut."""
    flat = F.trim(F.regexp_replace(column, r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length - 1), F.lit("…"))).otherwise(flat)


def guard_fence(column):
    """Tags that could close or open the fence around sources, made harmless."""
    return F.regexp_replace(column, "(?i)<(/?)(sources)>", "&lt;$1$2>")


def page_label(first, last):
    return F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("pp. "), first, F.lit("-"), last))


def source_block(number, section_path, first, last, text):
    """A numbered source as a prompt shows it: section and pages, then the passage."""
    where = guard_fence(F.array_join(F.coalesce(section_path, F.array().cast("array<string>")), " > "))
    header = F.concat(F.when(where == "", "").otherwise(F.concat(where, F.lit(" "))), F.lit("("), page_label(first, last), F.lit(")"))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), header, F.lit("\n"), guard_fence(text))


def roman_value(column):
    """Value of a roman numeral of any case."""
    one = F.map_from_arrays(F.array(*map(F.lit, "ivxlcdm")), F.array(*map(F.lit, (1, 5, 10, 50, 100, 500, 1000))))
    values = F.transform(F.filter(F.split(F.lower(column), ""), lambda c: c != ""), lambda c: F.element_at(one, c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, v: F.struct((s["sum"] + F.when(s["last"] < v, v - 2 * s["last"]).otherwise(v)).alias("sum"), v.alias("last"))
    return F.aggregate(values, start, step, lambda s: s["sum"])


def roman_text(number):
    """A number from 1 to 3999 as a Roman numeral in small letters."""
    digit = lambda power, one, five, ten: F.element_at(
        F.array(*[F.lit(t) for t in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (F.floor(number / power) % 10 + 1).cast("int")
    )
    whole = F.concat(F.repeat(F.lit("m"), F.floor(number / 1000).cast("int")), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))
    return F.when(number.between(1, 3999), whole)


def slug(column):
    """A name that is safe as a folder."""
    return F.regexp_replace(column, "[^A-Za-z0-9._-]+", "-")


def sentences(column):
    """Sentences of a text: a blank line ends one, and so does white space after a closing mark (with quotes or brackets around it)
    where the next word begins like a sentence: with a capital or a digit, a quote or bracket before it allowed."""
    blocks = F.split(column, r"\n\n+")
    # a mark is put after every possible end, then pieces whose successor begins small are joined again
    marked = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"((?:\.|!|\?)(?:\"|'|\)|\])*)(\s+)", "$1\u0001$2\u0002"), "\u0002"))
    opens = lambda p: F.rlike(p, F.lit(r"^(?:\"|'|\(|\[)?(?:\p{Lu}|\p{N})"))
    glued = F.transform(marked, lambda ps: F.array_join(F.transform(ps, lambda p, i: F.when((i > 0) & opens(p), F.concat(F.lit("\u0002"), p)).otherwise(p)), ""))
    parts = F.flatten(F.transform(glued, lambda g: F.split(F.replace(g, F.lit("\u0001"), F.lit("")), "\u0002")))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def money(column):
    """An amount for a reader: two decimals from a cent on, below it up to six without closing zeros, and 0 as such."""
    two = F.format_string("%.2f", column)
    six = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", column), "0+$", ""), r"\.$", "")
    return F.when(column == 0, F.lit("0")).when(column >= 0.01, two).otherwise(six)
