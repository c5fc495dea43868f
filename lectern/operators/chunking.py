"""Chunkers: fixed windows in the JVM, the sequential ones as Python generators over documents, and reports on chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import approx_tokens, utf16_units

MAX_TOKENS, OVERLAP = 400, 60
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ")
_SPANS = "{id} {kind}, chunk_no int, char_start int, char_end int, text string"
Span = tuple[int, int]


def _tokens(n: int) -> int:
    return -(-n // 4)


def as_units(text: str) -> str:
    """A text as a string of UTF-16 units, one character each, so that lengths and offsets count units; of a text within the basic
    plane that is the text itself."""
    if text.isascii() or max(text) < "\U00010000":
        return text
    return "".join(map(chr, np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").tolist()))


def from_units(units: str) -> str:
    return units.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def fixed_size(docs: DataFrame, size: int = MAX_TOKENS, overlap: int = OVERLAP, id_col: str = "doc_id") -> DataFrame:
    """Windows of ``size`` tokens of four UTF-16 units, each starting ``size - overlap`` after the last; blank ones are dropped.  A
    window that would begin or end within a surrogate pair begins or ends before it."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    units = utf16_units(F.col("text"))
    n = F.ceil(units / 4).cast("int")
    last = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))
    windows = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    astral = F.octet_length("text") != F.length("text")
    rows = docs.select(F.col(id_col), "text", units.alias("units"), (astral & (units != F.length("text"))).alias("wide"), F.explode(windows).alias("w")).withColumn("a", F.col("w") * step * 4)
    rows = rows.withColumn("b", F.least(F.col("a") + size * 4, F.col("units")))
    # the unit before a cut that is the first half of a pair: its upper byte is D8 to DB
    coded = F.encode("text", "UTF-16BE")
    half = lambda at: F.when(F.col("wide") & (at > 0) & (at < F.col("units")) & F.hex(F.substring(coded, 2 * at - 1, F.lit(1))).between("D8", "DB"), at - 1).otherwise(at)
    rows = rows.withColumn("char_start", half(F.col("a"))).withColumn("char_end", half(F.col("b")))
    length = F.col("char_end") - F.col("char_start")
    wide = F.decode(F.substring(coded, 2 * F.col("char_start") + 1, 2 * length), "UTF-16BE")
    rows = rows.withColumn("piece", F.when(F.col("wide"), wide).otherwise(F.substring("text", F.col("char_start") + 1, length)))
    return rows.filter(F.rlike("piece", F.lit(r"\S"))).select(id_col, F.col("w").alias("chunk_no"), "char_start", "char_end", F.col("piece").alias("text"))


def _pieces(text: str, a: int, b: int, separators: tuple[str, ...], limit: int) -> list[list[Span]]:
    """Groups of pieces within the limit; a piece that is too long is cut by finer separators into a group of its own."""
    if _tokens(b - a) <= limit:
        return [[(a, b)]]
    for i, sep in enumerate(separators):
        cuts, at = [], text.find(sep, a, b)
        while at >= 0:
            cuts.append(at + len(sep))
            at = text.find(sep, at + len(sep), b)
        cuts = [c for c in cuts if c < b]
        if not cuts:
            continue
        groups: list[list[Span]] = []
        run: list[Span] = []
        for s, e in zip([a, *cuts], [*cuts, b]):
            if _tokens(e - s) <= limit:
                run.append((s, e))
                continue
            if run:
                groups.append(run)
                run = []
            groups += _pieces(text, s, e, separators[i + 1 :], limit)
        return [*groups, run] if run else groups
    out, at = [], a
    while at < b:
        end = min(at + 4 * limit, b)
        if end < b and "\ud800" <= text[end - 1] <= "\udbff":
            end -= 1  # never inside a surrogate pair
        out.append([(at, end)])
        at = end
    return out


def _pack(pieces: list[Span], limit: int, overlap: int) -> list[Span]:
    """Runs of whole pieces within the limit; the next run starts with as many whole pieces as the overlap holds."""
    out, first, n = [], 0, len(pieces)
    while first < n:
        last = first + 1
        while last < n and _tokens(pieces[last][1] - pieces[first][0]) <= limit:
            last += 1
        out.append((pieces[first][0], pieces[last - 1][1]))
        if last == n:
            break
        nxt = last
        while nxt - 1 > first and _tokens(pieces[last - 1][1] - pieces[nxt - 1][0]) <= overlap and _tokens(pieces[last][1] - pieces[nxt - 1][0]) <= limit:
            nxt -= 1
        first = nxt
    return out


def _trim(text: str, a: int, b: int) -> Span | None:
    body = text[a:b]
    kept = body.strip()
    return (a + len(body) - len(body.lstrip()), a + len(body) - len(body.lstrip()) + len(kept)) if kept else None


def split_recursive(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Span]:
    """Spans cut at the coarsest separators that fit, packed greedily, trimmed; what an earlier span holds is left out."""
    out, covered = [], 0
    for group in _pieces(text, 0, len(text), SEPARATORS, limit) if text else []:
        for a, b in _pack(group, limit, overlap):
            span = _trim(text, a, b)
            if span and span[1] > covered:
                out.append(span)
                covered = span[1]
    return out


_END = re.compile(r"(?:[.]|[!]|[?])(?:\"|'|\)|\])*\s+")
_BLANK = re.compile(r"\n\n+")


def sentence_spans(text: str) -> list[Span]:
    """A blank line ends a sentence, and so does white space after a closing mark before a capital or a figure, a quote or bracket allowed."""
    cuts = {0, len(text), *(m.end() for m in _BLANK.finditer(text))}
    for m in _END.finditer(text):
        at = m.end()
        first = text[at + 1 : at + 2] if text[at : at + 1] in "\"'([" else text[at : at + 1]
        if first.isupper() or first.isdigit():
            cuts.add(at)
    order = sorted(cuts)
    return [s for a, b in zip(order, order[1:]) if (s := _trim(text, a, b))]


def hashed_embedding(text: str, dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for a model: words hashed to signed dimensions, scaled to length 1."""
    import zlib

    v = np.zeros(dim)
    for w in re.findall(r"\w+", text.lower()):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1 if h & 0x10000 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def split_semantic(text: str, limit: int = MAX_TOKENS, least: int = 60, percentile: float = 20.0, embed: Callable[[str], np.ndarray] = hashed_embedding) -> list[Span]:
    """Sentences gathered until the likeness of neighbours falls to its percentile (linear) or the limit is reached."""
    spans = [s for sent in sentence_spans(text) for s in ([sent] if _tokens(sent[1] - sent[0]) <= limit else [(sent[0] + a, sent[0] + b) for a, b in split_recursive(text[sent[0] : sent[1]], limit, 0)])]
    if not spans:
        return []
    vectors = [embed(text[a:b]) for a, b in spans]
    sims = [float(x @ y) for x, y in zip(vectors, vectors[1:])]
    bar = np.percentile(sims, percentile) if sims and percentile > 0 else -np.inf
    out, start = [], spans[0][0]
    for i, (a, b) in enumerate(spans[1:], 1):
        before = spans[i - 1][1]
        if _tokens(b - start) > limit or (sims[i - 1] <= bar and _tokens(before - start) >= least):
            out.append((start, before))
            start = a
    return [*out, (start, spans[-1][1])]


def generate(docs: DataFrame, split: Callable[[str], list[Span]], id_col: str = "doc_id") -> DataFrame:
    """Rows of a span generator over whole texts, in parallel over documents; it sees texts as UTF-16 units."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, no, s, e, from_units(t[s:e])) for i, t in zip(b[id_col], map(as_units, b["text"].fillna(""))) if t for no, (s, e) in enumerate(split(t))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "char_start", "char_end", "text"])

    return docs.select(id_col, "text").mapInPandas(run, _SPANS.format(id=id_col, kind=kind))


def recursive(docs: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP, id_col: str = "doc_id") -> DataFrame:
    return generate(docs, lambda t: split_recursive(t, limit, overlap), id_col)


def semantic(docs: DataFrame, limit: int = MAX_TOKENS, id_col: str = "doc_id") -> DataFrame:
    return generate(docs, lambda t: split_semantic(t, limit), id_col)


def structure_aware(docs: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP, id_col: str = "doc_id") -> DataFrame:
    """Cut where a section starts (numbered headings), small neighbours joined, long ones cut recursively."""
    heading = re.compile(r"(?m)^\d+(?:\.\d+)* \S[^\n.]*$")

    def split(text: str) -> list[Span]:
        cuts = sorted({0, *(m.start() for m in heading.finditer(text)), len(text)})
        joined: list[Span] = []
        for a, b in zip(cuts, cuts[1:]):
            if joined and (_tokens(joined[-1][1] - joined[-1][0]) < limit // 4 or _tokens(b - a) < limit // 4) and _tokens(b - joined[-1][0]) <= limit:
                joined[-1] = (joined[-1][0], b)
            else:
                joined.append((a, b))
        out = []
        for a, b in joined:
            inner = [(0, b - a)] if _tokens(b - a) <= limit else split_recursive(text[a:b], limit, overlap)
            out += [s for x, y in inner if (s := _trim(text, a + x, a + y))]
        return out

    return generate(docs, split, id_col)


def parent_child(docs: DataFrame, parent: int = MAX_TOKENS, child: int = 100, id_col: str = "doc_id") -> DataFrame:
    """Parents without overlap and their children, ``parent_no`` naming a child's parent; parents have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b[id_col], map(as_units, b["text"].fillna(""))):
                for no, (s, e) in enumerate(split_recursive(t, parent, 0) if t else []):
                    rows.append((i, no, None, s, e, from_units(t[s:e])))
                    rows += [(i, k, no, s + x, s + y, from_units(t[s + x : s + y])) for k, (x, y) in enumerate(split_recursive(t[s:e], child, child // 5))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "parent_no", "char_start", "char_end", "text"]).astype({"parent_no": "Int32"})

    return docs.select(id_col, "text").mapInPandas(run, f"{id_col} {kind}, chunk_no int, parent_no int, char_start int, char_end int, text string")


def with_context(chunks: DataFrame) -> DataFrame:
    """The text to embed: the section path before the passage."""
    path = F.array_join("section_path", " > ")
    return chunks.withColumn("embed_text", F.when(path == "", F.col("text")).otherwise(F.concat(path, F.lit("\n\n"), F.col("text"))))


def sizes(chunks: DataFrame, by: str = "strategy") -> DataFrame:
    """Count and sizes in tokens of the chunks of each group."""
    t = chunks.select(by, approx_tokens(F.col("text")).alias("n"))
    return t.groupBy(by).agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


def histogram(chunks: DataFrame, buckets: int = 8) -> DataFrame:
    """At most ``buckets`` equal widths of whole tokens, empty ones included: ``from_tokens, to_tokens, chunks``."""
    t = chunks.select(approx_tokens(F.col("text")).alias("n"))
    ends = t.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / buckets)).cast("bigint"))
    counts = t.crossJoin(F.broadcast(ends)).groupBy(F.floor((F.col("n") - F.col("lo")) / F.col("width")).alias("b")).agg(F.count("*").alias("chunks"))
    every = ends.select("lo", "hi", "width", F.explode(F.sequence(F.lit(0), F.ceil((F.col("hi") - F.col("lo") + 1) / F.col("width")) - 1)).alias("b"))
    low = F.col("lo") + F.col("b") * F.col("width")
    joined = every.join(counts, "b", "left").na.fill(0, ["chunks"])
    return joined.select(low.alias("from_tokens"), F.least(low + F.col("width"), F.col("hi") + 1).alias("to_tokens"), "chunks")


def page_ranges(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunk_id, first_page, last_page`` from spans: the first page that ends after the start, the last that starts before the end."""
    c, p = chunks.select("chunk_id", "doc_id", "char_start", "char_end").distinct().alias("c"), pages.select("doc_id", "page_no", F.col("char_start").alias("ps"), F.col("char_end").alias("pe")).alias("p")
    met = c.join(p, (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("p.pe") > F.col("c.char_start")) & (F.col("p.ps") < F.col("c.char_end")))
    return met.groupBy("chunk_id").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


def violations(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``chunk_id, problem``: empty texts, spans that do not fit their document, ids that occur more than once."""
    ends = documents.select("doc_id", utf16_units(F.col("text")).alias("n"))
    joined = chunks.join(ends, "doc_id", "left")
    problem = (
        F.when(~F.rlike("text", F.lit(r"\S")), "empty").when(F.col("n").isNull(), "no-document").when((F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")), "empty-span")
        .when(F.col("char_end") > F.col("n"), "beyond-document")
    )
    bad = joined.select("chunk_id", problem.alias("problem")).filter(F.col("problem").isNotNull())
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id", F.lit("duplicate-id").alias("problem"))
    return bad.unionByName(twice)
