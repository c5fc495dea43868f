"""Cutting oversized items at natural boundaries (problem 3).

Lexical cohesion: the words of the sentences before and after every sentence boundary are compared by cosine; a valley
of that similarity marks a change of topic, and its depth is the climb to the peaks on either side.  Each size
window is cut at its deepest valley; where a window holds no sentence boundary, at the last clause, else word, else by
length (never inside a surrogate pair).  A piece starts up to ``overlap`` before the cut: at the first sentence within it if
that keeps three quarters of the overlap, else at the first clause that does, else at the first word (so that less than a
word is missing), else exactly there.  The work grows in proportion to the length of a text.

Sizes and offsets count UTF-16 units, a token being four.  An item's place in its document is found again by counting
characters that are no white space, as item and document may differ in white space.

Results for odd input: null texts are not oversized; repeated item ids are cut once; an oversized text of white space
alone gives one empty piece; a text without white space is cut by length; an item whose document is missing has null
offsets; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import approx_tokens, join_side, materialize

UNITS_PER_TOKEN = 4
WINDOW = 3
SLICE = 8192

_SENTENCE = re.compile(r"[.!?…]+[\"'»”’)\]]*\s+|\n+\s*")
_CLAUSE = re.compile(r"[,;:–—]\s+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


def valley_depths(text: str, starts: list[int]) -> list[float]:
    """Depth of the cohesion valley at each sentence start but the first."""
    ends = [*starts[1:], len(text)]
    bags = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(starts, ends)]
    sims = []
    for i in range(1, len(starts)):
        left: Counter = sum(bags[max(0, i - WINDOW) : i], Counter())
        right: Counter = sum(bags[i : i + WINDOW], Counter())
        product = sum(n * right[w] for w, n in left.items())
        norm = sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        sims.append(product / norm if norm else 0.0)
    # the peaks on either side of every place: one pass each way
    left, right = sims[:], sims[:]
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left[i] = left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right[i] = right[i + 1]
    return [l + r - 2 * s for l, r, s in zip(left, right, sims)]


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans in code points of the pieces, each within ``limit`` UTF-16 units, whose ``overlap`` is also in units."""
    n = len(text)
    flat = text.isascii() or max(text) < "\U00010000"
    units = None if flat else np.concatenate([[0], np.cumsum([1 + (c > "￿") for c in text])])

    def reach(start: int, size: int) -> int:
        """The furthest end with at most ``size`` units from ``start``."""
        return min(n, start + size) if flat else int(np.searchsorted(units, units[start] + size, side="right")) - 1

    def back(end: int, size: int) -> int:
        return max(0, end - size) if flat else int(np.searchsorted(units, units[end] - size, side="left"))

    starts = [0, *(m.end() for m in _SENTENCE.finditer(text) if m.end() < n)]
    depths = valley_depths(text, starts)
    clauses = [m.end() for m in _CLAUSE.finditer(text)]
    words = [m.end() for m in _SPACE.finditer(text)]
    pieces: list[tuple[int, int]] = []
    start = 0
    while True:
        hi = reach(start, limit)
        if hi >= n:
            pieces.append((start, n))
            break
        lo = start + (hi - start) // 2
        # white space before a boundary may lie beyond the limit: it is no part of the piece
        a, b = bisect_right(starts, lo), bisect_right(starts, hi + 1)
        if a < b:
            at = max(range(a, b), key=lambda i: (depths[i - 1], starts[i]))
            cut = starts[at]
        else:
            cut = next((marks[i] for marks in (clauses, words) if (i := bisect_right(marks, hi + 1) - 1) >= 0 and marks[i] > lo), hi)
        cut = max(cut, start + 1)
        pieces.append((start, min(cut, hi)))
        if overlap <= 0:
            start = cut
            continue
        earliest = max(back(cut, overlap), start + 1)
        latest = back(cut, overlap - overlap // 4)
        start = earliest
        for marks, last in ((starts, latest), (clauses, latest), (words, cut - 1)):
            i = bisect_left(marks, earliest)
            if i < len(marks) and marks[i] <= last:
                start = marks[i]
                break
    out = []
    for a, b in pieces:
        body = text[a:b]
        kept = body.strip()
        if kept:
            a += len(body) - len(body.lstrip())
            out.append((a, a + len(kept)))
    return out or [(0, 0)]


def _unit_offsets(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (cp >= 0x10000))])


def _solid(text: str) -> np.ndarray:
    """Positions of the characters that are no white space."""
    return np.flatnonzero([not c.isspace() for c in text])


def split_oversized(
    items: DataFrame, documents: DataFrame, max_tokens: int, overlap_tokens: int, id_col: str = "chunk_id", doc_col: str = "doc_id"
) -> DataFrame:
    """``chunk_id, doc_id, piece_no, text, char_start, char_end, tokens, shared`` of the pieces of every item over ``max_tokens``; ``shared``
    counts the UTF-16 units at a piece's start that the piece before it ends with.

    Only documents with an oversized item are taken apart, into slices of SLICE units, and an item meets only the slices that its
    span touches, so neither a long document nor one with very many items gathers in a task."""
    big = materialize(
        items.filter(approx_tokens(F.col("text")) > max_tokens)
        .select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), "text", F.col("char_start").alias("cs"), F.col("char_end").alias("ce"))
        .dropDuplicates(["id"])
    )
    wanted = big.select("id", "doc", "cs", "ce", F.explode(F.sequence((F.col("cs") / SLICE).cast("int"), ((F.greatest("ce", F.col("cs") + 1) - 1) / SLICE).cast("int"))).alias("slice"))
    held = documents.select(F.col(doc_col).alias("doc"), "text").join(join_side(big.select("doc").distinct()), "doc", "left_semi")
    packed = held.select("doc", F.encode("text", "UTF-16BE").alias("bytes"))
    at = F.sequence(F.lit(0), ((F.greatest(F.octet_length("bytes"), F.lit(1)) - 1) / (2 * SLICE)).cast("int"))
    slices = packed.select("doc", F.posexplode(F.transform(at, lambda i: F.substring(F.col("bytes"), i * (2 * SLICE) + 1, F.lit(2 * SLICE)))).alias("slice", "bytes"))
    low = F.greatest(F.col("cs") - F.col("slice") * SLICE, F.lit(0))
    part = F.substring(F.col("bytes"), 2 * low + 1, 2 * (F.col("ce") - F.col("slice") * SLICE - low))
    spans = (
        wanted.join(slices, ["doc", "slice"])
        .select("id", F.struct("slice", part.alias("bytes")).alias("p"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_list("p")).alias("parts"))
    )
    joined = big.join(spans, "id", "left").select("id", "doc", "text", "cs", F.transform("parts", lambda p: p["bytes"]).alias("parts"))
    limit, overlap = max_tokens * UNITS_PER_TOKEN, overlap_tokens * UNITS_PER_TOKEN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, doc, text, start, parts in zip(b["id"], b["doc"], b["text"], b["cs"], b["parts"]):
                spans = split_text(text, limit, overlap)
                units = _unit_offsets(text)
                place = None
                if parts is not None:
                    source = b"".join(parts).decode("utf-16-be", "replace")
                    here, there, far = _solid(text), _solid(source), _unit_offsets(source)
                    if len(here) == len(there):
                        place = lambda a, e: (int(start + far[there[np.searchsorted(here, a)]]), int(start + far[there[np.searchsorted(here, e) - 1] + 1])) if e > a else (int(start), int(start))
                last = 0
                for no, (a, e) in enumerate(spans):
                    ps, pe = place(a, e) if place else (None, None)
                    rows.append((key, doc, no, text[a:e], ps, pe, int(-(-(units[e] - units[a]) // UNITS_PER_TOKEN)), int(max(0, units[last] - units[a]))))
                    last = e
            out = pd.DataFrame(rows, columns=["id", "doc", "piece_no", "text", "char_start", "char_end", "tokens", "shared"])
            yield out.astype({"char_start": "Int32", "char_end": "Int32"})

    kind = items.schema[id_col].dataType.simpleString()
    doc_kind = items.schema[doc_col].dataType.simpleString()
    pieces = joined.mapInPandas(run, f"id {kind}, doc {doc_kind}, piece_no int, text string, char_start int, char_end int, tokens int, shared int")
    return pieces.withColumnsRenamed({"id": id_col, "doc": doc_col})


#: White space of either language, as a class of code points.
WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def rejoined(pieces: DataFrame, documents: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_id") -> DataFrame:
    """``chunk_id, solid, most_tokens, most_shared, misplaced``: each item put together again from its pieces, what pieces share
    counted once, as the SHA-256 of its characters that are no white space; the sizes of its largest piece and overlap in tokens; and
    how many of its pieces differ in more than white space from their span in the document.

    An item holds few pieces, which is what is gathered."""
    units = lambda text, start, n: F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * start + 1, 2 * n), "UTF-16BE")
    solid = lambda c: F.regexp_replace(c, WHITE, "")
    source = documents.select(F.col(doc_col), F.col("text").alias("source"))
    there = pieces.join(source, doc_col, "left")
    apart = solid(units(F.col("source"), F.col("char_start"), F.col("char_end") - F.col("char_start"))) != solid(F.col("text"))
    own = units(F.col("text"), F.col("shared"), F.lit(2**29))
    rows = there.select(id_col, F.struct("piece_no", solid(own).alias("t")).alias("p"), "tokens", "shared", F.coalesce(apart, F.lit(False)).alias("apart"))
    sums = rows.groupBy(id_col).agg(
        F.array_sort(F.collect_list("p")).alias("p"), F.max("tokens").cast("bigint").alias("most_tokens"),
        F.max(F.ceil(F.col("shared") / UNITS_PER_TOKEN)).cast("bigint").alias("most_shared"), F.count_if("apart").alias("misplaced"),
    )
    return sums.withColumn("solid", F.sha2(F.array_join(F.transform("p", lambda x: x["t"]), ""), 256)).drop("p")
