"""Edits of page texts, with what was located in the old text located anew.

An edit ``doc_id, page_no, start, end, replacement`` replaces a span of its page's text; spans count UTF-16 units.  A range's
start that lies within a replaced span moves behind the replacement and its end before it, so nothing that was removed stays inside a range."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import utf16_units
from .chunking import as_units, from_units

SEPARATOR = 2  # units between two pages
SLICE = 256  # pages whose edits and items are Python objects at once


class Edited:
    """A text of UTF-16 units after its edits, and where places of the old text lie in the new one."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.old: list[tuple[int, int]] = []
        self.new: list[tuple[int, int]] = []
        parts, at, size = [], 0, 0
        for start, end, by in sorted(edits):
            if start < at or end < start or end > len(text):
                raise ValueError(f"edit [{start}, {end}) overlaps another or leaves the text")
            parts += [text[at:start], by]
            size += start - at
            self.old.append((start, end))
            self.new.append((size, size + len(by)))
            size += len(by)
            at = end
        self.text = "".join([*parts, text[at:]])
        self._ends = [e for _, e in self.old]

    def place(self, at: int, is_end: bool) -> int:
        """Where a range's start or end lies now."""
        done = bisect_right(self._ends, at)
        if done < len(self.old) and self.old[done][0] < at:
            return self.new[done][0] if is_end else self.new[done][1]
        return at + (self.new[done - 1][1] - self.old[done - 1][1] if done else 0)


def _rows(column: pa.ListArray, *fields: str) -> Iterator[list[tuple]]:
    """The structs of each row, as tuples of ``fields``."""
    flat = column.flatten()
    plain = lambda x: x.to_pylist() if x.null_count else x.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  # the latter is ten times faster
    structs = list(zip(*(plain(flat.field(f)) for f in fields)))
    at = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield structs[at : at + n]
        at += n


def edited_batches(batches: Iterator[pa.RecordBatch], find: Callable[[str], list[tuple[int, int, str]]] | None = None) -> Iterator[pa.RecordBatch]:
    """Pages with their edited text and the items left, ``SLICE`` pages at a time; what a batch holds besides stays in Arrow's arrays.

    The edits are those that ``find`` gives for a page's text, without it those of the column ``edits``."""
    kind = pa.list_(pa.struct([("item_no", pa.int32()), ("text", pa.string()), ("a", pa.int32()), ("z", pa.int32())]))
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            b = whole.slice(at, SLICE)
            units = [as_units(t or "") for t in b["text"].to_pylist()]
            edits = map(find, units) if find else ([(a, z, as_units(by or "")) for a, z, by in own] for own in _rows(b["edits"], "start", "end", "replacement"))
            edited = [Edited(u, e) for u, e in zip(units, edits)]
            columns = {"doc_id": b["doc_id"], "page_no": b["page_no"], "text": pa.array([from_units(e.text) for e in edited], b["text"].type)}
            if "items" in b.schema.names:
                kept = []
                for done, start, items in zip(edited, b["char_start"].to_pylist(), _rows(b["items"], "item_no", "start", "end")):
                    spans = ((no, done.place(x - start, False), done.place(y - start, True)) for no, x, y in items)
                    kept.append([{"item_no": no, "text": from_units(done.text[a:z]), "a": a, "z": z} for no, a, z in spans if z > a])
                columns["items"] = pa.array(kept, kind)
            yield pa.RecordBatch.from_pydict(columns)


def apply_edits(pages: DataFrame, edits: DataFrame | Callable[[str], list[tuple[int, int, str]]], items: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pages ``doc_id, page_no, text`` after the edits, with their spans in the document, ``char_start, char_end``; and the items
    ``doc_id, page_no, item_no, text, start, end`` (spans in the document) with text and span after them, without those of which nothing is left.

    Edits that follow from a page's own text may be given as a function, which gets the text as a string of UTF-16 units, one character
    each, and gives ``start, end, replacement``: they are then made where the page is read and nothing is shuffled to bring them to it.
    A task holds the edits and items of few pages at once, however many a batch has."""
    by_page = ["doc_id", "page_no"]
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("units").over(before), F.lit(0)).cast("int")
    sized = lambda df: df.withColumn("units", utf16_units(F.col("text")) + SEPARATOR).withColumn("char_start", offset)
    placed = pages.select(*by_page, "text")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in by_page) + ", text string"
    if items is not None:
        held = items.groupBy(*by_page).agg(F.collect_list(F.struct(F.col("item_no").cast("int").alias("item_no"), "start", "end")).alias("items"))
        placed = sized(placed).drop("units").join(held, by_page, "left")
        kinds += ", items array<struct<item_no:int,text:string,a:int,z:int>>"
    find = None if isinstance(edits, DataFrame) else edits
    if find is None:
        own = edits.groupBy(*by_page).agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
        placed = placed.join(own, by_page, "left")
    anew = sized(placed.mapInArrow(lambda batches: edited_batches(batches, find), kinds))
    out = anew.select(*by_page, "text", "char_start", (F.col("char_start") + F.col("units") - SEPARATOR).cast("int").alias("char_end"))
    if items is None:
        return out, None
    rest = [c for c in items.columns if c not in ("text", "start", "end")]
    spans = anew.select(*by_page, "char_start", F.explode("items").alias("i")).select(*by_page, F.col("i.item_no").alias("item_no"), F.col("i.text").alias("text"), (F.col("char_start") + F.col("i.a")).alias("start"), (F.col("char_start") + F.col("i.z")).alias("end"))
    return out, items.select(*rest).join(spans, [*by_page, "item_no"])
