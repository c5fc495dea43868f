"""Texts around a model: history, variants, rewrites and replies.  All JVM expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X


def format_history(turns, last: int = 4, answer_chars: int = 400):
    """The last turns of ``array<struct<question,answer>>``, on one line each, marks stripped and answers cut with an ellipsis."""
    line = lambda c: F.trim(F.regexp_replace(X.without_marks(c), r"\s+", " "))
    cut = lambda c: F.when(F.length(c) <= answer_chars, c).otherwise(F.concat(F.substring(c, 1, answer_chars - 1), F.lit("…")))
    recent = F.slice(turns, F.greatest(F.size(turns) - last + 1, F.lit(1)), last)
    return F.array_join(F.transform(recent, lambda t: F.concat(F.lit("Q: "), line(t["question"]), F.lit("\nA: "), cut(line(t["answer"])))), "\n")


def clean_rewrite(reply, most: int = 500):
    """The question on the first line of a reply that is not blank, without label and quotes; null where none is left or it is longer
    than ``most`` characters, so that the question asked stays."""
    lines = F.filter(F.transform(F.split(reply, "\n"), F.trim), lambda l: l != "")
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?i)^(?:rewritten\s+)?(?:question|query)\s*:\s*", ""), "^[\"'“‘]+|[\"'”’]+$", ""))
    return F.when((bare != "") & (F.length(bare) <= most), bare)


def clean_variants(reply, count: int = 3, question=None, known=None):
    """Lines of a reply without list marks, each once whatever its case, the first ``count``; the ``question`` itself and the variants
    ``known`` before are left out."""
    lines = F.transform(F.split(reply, "\n"), lambda l: F.trim(F.regexp_replace(l, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    lines = F.filter(lines, lambda l: l != "")
    lowered = F.transform(lines, F.lower)
    old = F.array().cast("array<string>") if known is None else F.transform(known, F.lower)
    old = old if question is None else F.array_append(old, F.lower(F.trim(question)))
    return F.slice(F.filter(lines, lambda l, i: (F.array_position(lowered, F.lower(l)) == i + 1) & ~F.array_contains(old, F.lower(l))), 1, count)


def selection_text(column, limit: int = 1000):
    return F.substring(F.trim(F.regexp_replace(column, r"\s+", " ")), 1, limit)


def score_reply(reply):
    """The score, 0 to 10, of the first flat JSON object in a reply that has one; a quoted number is none."""
    objects = F.regexp_extract_all(reply, F.lit(r"\{[^{}]*\}"), F.lit(0))
    numbers = F.transform(objects, lambda o: F.regexp_extract(o, r"\"score\"\s*:\s*(-?\d+(?:\.\d+)?)\s*[,}]", 1))
    value = F.get(F.filter(numbers, lambda n: n != ""), F.lit(0)).cast("double")
    return F.when(value.between(0, 10), value)


def verdict_value(column):
    """Judge's verdict as a number: supported 1, partial a half, unsupported 0."""
    return F.when(column == "supported", 1.0).when(column == "partial", 0.5).when(column == "unsupported", 0.0)
