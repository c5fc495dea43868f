"""Metadata filters: clauses compiled to one predicate, joined by AND; no clause means all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(part: str) -> str:
    return part.strip().lower()


def equals(field: str, value: str) -> Column:
    return F.col(field) == F.lit(value)


def any_of(field: str, values: list[str]) -> Column:
    """An empty list matches nothing."""
    return F.col(field).isin(values) if values else F.lit(False)


def page_range(first: int | None = None, last: int | None = None) -> Column:
    """Rows whose pages overlap the range; an end may be open."""
    if (first is not None and first < 1) or (last is not None and last < 1) or (first and last and first > last):
        raise ValueError("pages count from 1 and a range may not run backwards")
    parts = [F.col("page_end") >= first] if first is not None else []
    parts += [F.col("page_start") <= last] if last is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def section(path: list[str]) -> Column:
    """Rows under a section path, compared element by element without case; a missing path matches nothing."""
    if not path or any(not p.strip() for p in path):
        raise ValueError("a section path needs titles")
    folded = F.transform(F.slice(F.col("section_path"), 1, len(path)), lambda p: F.lower(F.trim(p)))
    return F.coalesce(folded == F.array(*[F.lit(_fold(p)) for p in path]), F.lit(False))


def all_of(*clauses: Column) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def parse_pages(text: str) -> tuple[int | None, int | None]:
    """``12``, ``10-20``, ``10-`` or ``-20``."""
    first, dash, last = text.strip().partition("-")
    if not dash:
        return int(first), int(first)
    if not first and not last:
        raise ValueError("an empty page range")
    return (int(first) if first else None), (int(last) if last else None)


def from_request(documents: list[str] | None = None, strategies: list[str] | None = None, section_path: list[str] | None = None, pages: dict | None = None) -> Column:
    """The clauses of a request joined by AND; one value is compared, several are looked up, and what is not given is no clause."""
    parts = []
    for field, values in (("doc_id", documents), ("strategy", strategies)):
        if values is not None:
            parts.append(equals(field, values[0]) if len(values) == 1 else any_of(field, values))
    if section_path is not None:
        parts.append(section(section_path))
    if pages is not None:
        parts.append(page_range(pages.get("from"), pages.get("to")))
    return all_of(*parts)


def parse_arguments(arguments: dict[str, list[str]]) -> Column:
    """The filter of a command line: ``doc``, ``strategy`` (repeatable), ``section`` (titles parted by ``>``) and ``pages``."""
    unknown = set(arguments) - {"doc", "strategy", "section", "pages"}
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    titles, span = arguments.get("section"), arguments.get("pages")
    if (titles and len(titles) > 1) or (span and len(span) > 1):
        raise ValueError("a section and a page range can be given once")
    first, last = parse_pages(span[0]) if span else (None, None)
    return from_request(arguments.get("doc"), arguments.get("strategy"), [t.strip() for t in titles[0].split(">")] if titles else None, {"from": first, "to": last} if span else None)


def byte_range(header: Column, size: Column) -> Column:
    """What a ``Range`` header asks of a file of ``size`` bytes, ``struct<kind,start,end>``: ``whole`` where it is no single range of
    bytes, ``unsatisfiable`` where it begins behind the file, else ``partial`` with both ends within it."""
    given = F.trim(F.coalesce(header, F.lit("")))
    ends = F.split(F.substring(given, 7, 2**30), "-")
    sound = F.startswith(given, F.lit("bytes=")) & (F.size(ends) == 2) & (F.translate(F.array_join(ends, ""), "0123456789", "") == "") & (F.length(given) > 7)
    low, high = (F.nullif(F.get(ends, F.lit(i)), F.lit("")).cast("bigint") for i in (0, 1))
    start = F.when(low.isNull(), F.greatest(F.lit(0), size - high)).otherwise(low)
    end = F.when(low.isNull() | high.isNull(), size - 1).otherwise(F.least(high, size - 1))
    kind = F.when(~sound, "whole").when((low.isNull() & (high == 0)) | (low >= size), "unsatisfiable").when(end < start, "whole").otherwise("partial")
    part = kind == "partial"
    return F.struct(kind.alias("kind"), F.when(part, start).alias("start"), F.when(part, end).alias("end"))
