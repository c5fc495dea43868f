"""Cleaners of page texts.  Pages are rows ``doc_id, page_no, page_index, text``; a cleaner maps such a table to another.

The order that a configuration names is a fold over the table: ``unicode, page-numbers, headers-footers, dehyphenate``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.cluster import materialize, utf16_units

EDGE = 3
MIN_NUMBERED, MIN_REPEATED = 2, 3
DASHES = "-–—"
#: Characters that the rules on single characters look for, and white space that the rules on spaces change.
_RARE = r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{2010}\x{2011}\x{FB00}-\x{FB06}]"
_LOOSE = r"\r|\n\n\n|^\n|\n$|[ \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}](?:[ \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\n]|$)|[\t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Letter pairs that are one glyph (fixed values).
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_SPACE = r"[ \t   -   　]+"


def _line_ends(c):
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"^\n+|\n+$", ""), r"\n{3,}", "\n\n")


def _spaces(c):
    return F.regexp_replace(F.regexp_replace(c, _SPACE + r"(?=\n|$)", ""), _SPACE, " ")


def clean_unicode(column):
    """Line ends, blank lines, invisible characters, ligatures and spaces of one page's text.

    A text without the characters that a rule changes skips it: most pages pass two searches and no replacement."""
    c = F.regexp_replace(F.regexp_replace(_line_ends(column), "\u00ad(?=\n)", "-"), r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    c = F.regexp_replace(c, r"[\x{2010}\x{2011}]", "-")
    for glyph, letters in LIGATURES.items():
        c = F.replace(c, F.lit(glyph), F.lit(letters))
    plain = F.octet_length(column) == F.length(column)
    return F.when(~plain & F.rlike(column, F.lit(_RARE)), _spaces(c)).when(F.rlike(column, F.lit(_LOOSE)), _spaces(_line_ends(column))).otherwise(column)


def unicode_cleaner(pages: DataFrame) -> DataFrame:
    """Composing accents has no built-in: only pages with a combining mark go through Python, the others never leave the JVM."""
    apart = F.coalesce((F.octet_length("text") != F.length("text")) & F.rlike("text", F.lit(r"\p{L}\p{M}")), F.lit(False))
    cleaned = clean_unicode(F.col("text"))
    composed = pages.filter(apart).withColumn("text", cleaned).withColumn("text", X.compose("text", F.lit("NFC")))
    return pages.filter(~apart).withColumn("text", cleaned).unionByName(composed)


def edge_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, page_index, line_no, line`` of the first and last EDGE lines that are not blank."""
    marked = F.filter(F.transform(F.split("text", "\n"), lambda l, i: F.struct(i.alias("line_no"), l.alias("line"))), lambda s: F.rlike(s["line"], F.lit(r"\S")))
    picked = F.array_distinct(F.concat(F.slice("solid", 1, EDGE), F.slice("solid", F.greatest(F.size("solid") - EDGE + 1, F.lit(1)), EDGE)))
    solid = pages.select("doc_id", "page_no", "page_index", marked.alias("solid")).filter(F.size("solid") > 0)
    return solid.select("doc_id", "page_no", "page_index", F.explode(picked).alias("e")).select("doc_id", "page_no", "page_index", "e.line_no", "e.line")


def _number(c):
    """A column that is nothing but one to four figures, as such, else null."""
    return F.when(F.length(c).between(1, 4) & (F.translate(c, "0123456789", "") == ""), c)


def printed_numbers(lines: DataFrame) -> DataFrame:
    """Of rows with a ``line`` those that are nothing but a page number, with its ``kind`` and ``value``: figures, alone, after the word
    for a page or before the number of all pages; figures between dashes; or a Roman numeral.

    Each step reads the columns of the one before, as each is used several times."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    dash = lambda c: F.instr(F.lit(DASHES), c) > 0
    low = lines.filter(F.length("line") <= 200).withColumn("low", F.lower(trimmed(F.col("line"))))
    # nothing else can be left when figures, numerals, the two words and the marks are taken away
    low = low.filter((F.length("low") <= 40) & (F.translate("low", "0123456789ivxlcdmpageof/ \t" + DASHES, "") == ""))
    after = F.regexp_replace(F.substring("low", 5, 40), r"^\s+", "")
    told = F.startswith("low", F.lit("page")) & (F.length(after) < F.length("low") - 4)
    rest = low.withColumn("rest", F.when(told, after).otherwise(F.col("low")))
    parts = rest.withColumn("parts", F.split(F.regexp_replace(F.replace("rest", F.lit("of"), F.lit("/")), r"\s*/\s*", "/"), "/"))
    first, second = _number(F.get("parts", F.lit(0))), _number(F.get("parts", F.lit(1)))
    counted = F.when((F.size("parts") == 1) | ((F.size("parts") == 2) & second.isNotNull()), first)
    between = F.when((F.length("low") > 2) & dash(F.substring("low", 1, 1)) & dash(F.substring("low", -1, 1)), _number(trimmed(F.substring("low", F.lit(2), F.length("low") - 2))))
    figures = parts.withColumn("figures", F.coalesce(counted, between).cast("int"))
    letters = F.length("rest").between(1, 15) & (F.translate("rest", "ivxlcdm", "") == "")
    roman = figures.withColumn("roman", F.when(letters, X.roman_value(F.col("rest"))))
    roman = roman.withColumn("roman", F.when(X.roman_text(F.col("roman")) == F.col("rest"), F.col("roman")))
    found = roman.filter(F.col("figures").isNotNull() | F.col("roman").isNotNull())
    kind = F.when(F.col("figures").isNotNull(), "arabic").otherwise("roman")
    return found.withColumn("kind", kind).withColumn("value", F.coalesce("figures", "roman")).drop("low", "rest", "parts", "figures", "roman")


def page_number_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no, kind, offset`` of edge lines that hold a page number, accepted where two pages of a
    document have the same distance between printed number and page."""
    found = materialize(printed_numbers(edge_lines(pages)).select("doc_id", "page_no", "line_no", "kind", (F.col("value") - F.col("page_no")).alias("offset")))
    steady = found.groupBy("doc_id", "kind", "offset").agg(F.countDistinct("page_no").alias("n")).filter(F.col("n") >= MIN_NUMBERED)
    return found.join(steady, ["doc_id", "kind", "offset"], "left_semi").select("doc_id", "page_no", "line_no", "kind", "offset")


def repeat_key(column):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(column), r"\d+", "#"), r"\s+", " "))


def running_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no, key`` of edge lines that stand, digits aside, on more than half of a document's pages with
    text, or of those of one parity."""
    parity = F.pmod("page_index", F.lit(2))
    with_text = pages.filter(F.rlike("text", F.lit(r"\S")))
    sizes = with_text.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(parity == 0).alias("n0"), F.count_if(parity == 1).alias("n1")).filter(F.col("n") >= MIN_REPEATED)
    edges = edge_lines(pages).withColumn("key", repeat_key(F.col("line"))).filter("key <> ''")
    seen = edges.select("doc_id", "key", "page_index").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("c"), F.count_if(parity == 0).alias("c0"), F.count_if(parity == 1).alias("c1"))
    often = (F.col("c") > F.col("n") / 2) | ((F.col("n0") >= MIN_REPEATED) & (F.col("c0") > F.col("n0") / 2)) | ((F.col("n1") >= MIN_REPEATED) & (F.col("c1") > F.col("n1") / 2))
    keys = seen.join(sizes, "doc_id").filter(often).select("doc_id", "key")
    return edges.join(keys, ["doc_id", "key"], "left_semi").select("doc_id", "page_no", "line_no", "key")


def remove_lines(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Pages without the given lines; at the top and bottom of a page the blank lines next to them go too."""
    gone = lines.groupBy("doc_id", "page_no").agg(F.collect_set("line_no").alias("gone"))
    joined = pages.join(gone, ["doc_id", "page_no"], "left")
    parts = F.split("text", "\n")
    kept = F.filter(F.transform(parts, lambda l, i: F.struct(l.alias("l"), F.array_contains("gone", i).alias("x"))), lambda s: ~s["x"])
    body = F.array_join(F.transform(kept, lambda s: s["l"]), "\n")
    first, last = F.array_contains("gone", 0), F.array_contains("gone", F.size(parts) - 1)
    body = F.when(first, F.regexp_replace(body, r"^(?:[^\S\n]*\n)+", "")).otherwise(body)
    body = F.when(last, F.regexp_replace(body, r"(?:\n[^\S\n]*)+$", "")).otherwise(body)
    return joined.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(body)).drop("gone")


def page_number_cleaner(pages: DataFrame) -> DataFrame:
    return remove_lines(pages, page_number_lines(pages))


def header_footer_cleaner(pages: DataFrame) -> DataFrame:
    return remove_lines(pages, running_lines(pages))


def dehyphenate(column):
    """Words broken over a line end: a hyphen after two letters, before a small letter of the next line, goes."""
    broken = r"(\p{L}\p{L})(?:-|\x{2010}|\x{2011})(?:\x20|\t)*\n(\p{Ll})"
    # a page without a hyphen at a line's end is left alone
    return F.when(F.rlike(column, F.lit(r"[-\x{2010}\x{2011}][ \t]*\n")), F.regexp_replace(column, broken, "$1$2")).otherwise(column)


def dehyphenate_cleaner(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", dehyphenate(F.col("text")))


CLEANERS = {"unicode": unicode_cleaner, "page-numbers": page_number_cleaner, "headers-footers": header_footer_cleaner, "dehyphenate": dehyphenate_cleaner}


def clean(pages: DataFrame, names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in CLEANERS]
    if unknown:
        raise ValueError(f"unknown cleaners: {', '.join(unknown)}")
    # cleaners that look at edge lines read their pages twice: what came before is computed once
    twice = {"page-numbers", "headers-footers"}
    return reduce(lambda df, n: CLEANERS[n](materialize(df) if n in twice else df), names, pages)


def assemble(pages: DataFrame) -> DataFrame:
    """Documents from pages, joined by a blank line, with the running span of each page: ``doc_id, page_no, char_start, char_end``."""
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    n = utf16_units(F.col("text"))
    start = F.coalesce(F.sum(n + 2).over(before), F.lit(0))
    return pages.select("doc_id", "page_no", start.cast("int").alias("char_start"), (start + n).cast("int").alias("char_end"))
