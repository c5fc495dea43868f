"""Lines, headings and sections of pages that carry positioned items.

Items are rows ``doc_id, page_no, item_no, text, x, y, font_size, is_bold, start, end``; a page is what a task holds, and
sections need the headings of a document only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RATIO, MAX_LENGTH, MAX_BOLD_LENGTH, MAX_RANKS = 1.15, 200, 80, 6
OVERUSED_SHARE, OVERUSED_FROM = 0.3, 20
_LINES = "doc_id string, page_no int, line_no int, text string, size double, is_bold boolean, chars int, y double, start int, end int"


def group_lines(items: DataFrame) -> DataFrame:
    """Items in order share a line while their height differs from the line's first item by at most a third of the larger font."""

    def lines_of(doc, no, items) -> list[tuple]:
        rows, line = [], []

        def close():
            if not line:
                return
            visible = [len("".join(i["text"].split())) for i in line]
            by_size: dict[float, int] = {}
            for i, n in zip(line, visible):
                size = round(i["font_size"] * 2) / 2
                by_size[size] = by_size.get(size, 0) + n
            total = sum(visible)
            bold = sum(n for i, n in zip(line, visible) if i["is_bold"])
            size = max(by_size, key=by_size.get)
            rows.append((doc, no, len(rows), "".join(i["text"] for i in line).strip(), size, total > 0 and bold >= 0.9 * total, total, line[0]["y"], line[0]["start"], line[-1]["end"]))

        for item in sorted(items, key=lambda i: i["item_no"]):
            if line and abs(item["y"] - line[0]["y"]) > max(item["font_size"], line[0]["font_size"]) / 3:
                close()
                line = []
            line.append(item)
        close()
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for doc, no, its in zip(b["doc_id"], b["page_no"], b["items"]) for r in lines_of(doc, no, its)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "line_no", "text", "size", "is_bold", "chars", "y", "start", "end"])

    # a page is one row, and a batch holds many
    pages = items.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("item_no", "text", "y", "font_size", "is_bold", "start", "end")).alias("items"))
    return pages.mapInPandas(run, _LINES)


def body_style(lines: DataFrame) -> DataFrame:
    """The style with most visible characters of each document; the one seen first on a tie."""
    styles = lines.groupBy("doc_id", "size", "is_bold").agg(F.sum("chars").alias("n"), F.min(F.struct("page_no", "line_no")).alias("at"))
    best = styles.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "at", "size", "is_bold")).alias("b"))
    return best.select("doc_id", F.col("b.size").alias("body_size"), F.col("b.is_bold").alias("body_bold"))


def heading_lines(lines: DataFrame) -> DataFrame:
    """Lines set larger than the body, or short bold ones on pages that are not bold throughout; styles used for too many
    lines of a document are no headings."""
    body = body_style(lines)
    pages = lines.groupBy("doc_id", "page_no").agg((F.sum(F.when(F.col("is_bold"), F.col("chars")).otherwise(0)) > F.sum("chars") / 2).alias("bold_page"))
    sizes = lines.groupBy("doc_id").agg(F.count("*").alias("n"))
    styles = lines.groupBy("doc_id", "size", "is_bold").agg(F.count("*").alias("used"))
    all_ = lines.join(body, "doc_id").join(pages, ["doc_id", "page_no"]).join(sizes, "doc_id").join(styles, ["doc_id", "size", "is_bold"])
    letter = F.rlike("text", F.lit(r"\p{L}")) & (F.length("text") <= MAX_LENGTH)
    larger = F.col("size") >= RATIO * F.col("body_size")
    bold = F.col("is_bold") & ~F.col("body_bold") & ~F.col("bold_page") & (F.length("text") <= MAX_BOLD_LENGTH) & (F.col("size") >= F.col("body_size"))
    rare = (F.col("n") < OVERUSED_FROM) | (F.col("used") <= OVERUSED_SHARE * F.col("n"))
    return all_.filter(letter & (larger | bold) & rare).select(*lines.columns)


def merge_wrapped(headings: DataFrame) -> DataFrame:
    """Neighbouring heading lines of one page and style, at most two sizes apart, are one title."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "line_no")
    joined = (
        (F.lag("page_no").over(order) == F.col("page_no")) & (F.lag("line_no").over(order) == F.col("line_no") - 1) & (F.lag("size").over(order) == F.col("size"))
        & (F.lag("is_bold").over(order) == F.col("is_bold")) & (F.abs(F.lag("y").over(order) - F.col("y")) <= 2 * F.col("size"))
    )
    marked = headings.withColumn("title_no", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return marked.groupBy("doc_id", "title_no").agg(
        F.min("page_no").alias("page_no"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("title"),
        F.first("size").alias("size"), F.first("is_bold").alias("is_bold"), F.min("start").alias("start"), F.max("end").alias("title_end"),
    )


def sections(titles: DataFrame, documents: DataFrame) -> DataFrame:
    """``doc_id, ord, parent_ord, level, title, path, start, end``: larger styles rank higher, bold before plain; a heading closes
    the open sections of its rank or lower.  ``documents`` gives each document's length, ``doc_id, length``."""
    schema = "doc_id string, ord int, parent_ord int, level int, title string, path array<string>, start int, end int"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start").reset_index(drop=True)
        styles = sorted({(-s, not b) for s, b in zip(group["size"], group["is_bold"])})
        rank = [min(styles.index((-s, not b)), MAX_RANKS - 1) for s, b in zip(group["size"], group["is_bold"])]
        open_: list[int] = []
        rows = []
        for i, row in enumerate(group.itertuples()):
            while open_ and rank[open_[-1]] >= rank[i]:
                rows[open_.pop()][7] = row.start
            path = [rows[j][4] for j in open_] + [row.title]
            rows.append([row.doc_id, i, open_[-1] if open_ else None, len(path), row.title, path, row.start, int(group["length"].iloc[0])])
            open_.append(i)
        return pd.DataFrame(rows, columns=["doc_id", "ord", "parent_ord", "level", "title", "path", "start", "end"]).astype({"parent_ord": "Int32"})

    return titles.join(documents, "doc_id").groupBy("doc_id").applyInPandas(run, schema)


def numbered_headings(parsed: DataFrame) -> DataFrame:
    """Headings of texts without items, by their numbers: ``doc_id, line_no, number, level, title``."""
    lines = parsed.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    number = F.regexp_extract("line", r"^(\d+(?:\.\d+)*) \S.*[^.!?]$", 1)
    found = lines.withColumn("number", number).filter("number <> ''")
    return found.select("doc_id", F.col("line_no").cast("int"), "number", F.size(F.split("number", r"\.")).alias("level"), F.substring("line", F.length("number") + 2, F.length("line")).alias("title"))


def section_paths(positions: DataFrame, tree: DataFrame) -> DataFrame:
    """``doc_id, position, path`` of the deepest section around each position; an empty path outside all."""
    p, s = positions.alias("p"), tree.alias("s")
    inside = p.join(s, (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("s.start") <= F.col("p.position")) & (F.col("p.position") < F.col("s.end")), "left")
    return inside.groupBy("p.doc_id", "p.position").agg(F.coalesce(F.max_by("path", "level"), F.array().cast("array<string>")).alias("path"))


def outline(tree: DataFrame) -> DataFrame:
    """``doc_id, outline``: indented titles in order, with their pages where the tree has ``page_start`` and ``page_end``."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("title"))
    if "page_start" in tree.columns:
        one = F.col("page_start") == F.col("page_end")
        pages = F.when(one, F.concat(F.lit("p."), "page_start")).otherwise(F.concat(F.lit("pp."), "page_start", F.lit("-"), "page_end"))
        line = F.concat(line, F.lit("  ("), pages, F.lit(")"))
    rows = tree.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("outline"))


def markdown(documents: DataFrame, pages: DataFrame, tree: DataFrame) -> DataFrame:
    """``doc_id, markdown``: the whole text, headings as ``#`` lines by level and a comment where each page starts.

    ``documents`` hold ``doc_id, text``, ``pages`` ``doc_id, page_no, char_start``, ``tree`` ``doc_id, level, title, start, title_end``
    (offsets in characters).  Pieces between the marks are cut by column functions; a document's text is one row."""
    page = pages.select("doc_id", F.col("char_start").alias("at"), F.lit(0).alias("rank"), F.col("char_start").alias("goes_on"), F.concat(F.lit("<!-- page "), "page_no", F.lit(" -->")).alias("mark"))
    head = F.concat(F.repeat(F.lit("#"), F.least(F.col("level"), F.lit(6))), F.lit(" "), F.col("title"))
    marks = page.unionByName(tree.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("rank"), F.col("title_end").alias("goes_on"), head.alias("mark")))
    gathered = marks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "rank", "goes_on", "mark"))).alias("marks"))
    joined = documents.select("doc_id", "text").join(gathered, "doc_id", "left")
    cut = lambda a, b: F.substring("text", a + 1, F.greatest(b - a, F.lit(0)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, m: F.struct(
        F.concat(s["out"], F.when(m["at"] > s["at"], cut(s["at"], m["at"])).otherwise(""), F.lit("\n\n"), m["mark"], F.lit("\n\n")).alias("out"),
        F.greatest(s["at"], m["at"], m["goes_on"]).cast("int").alias("at"),
    )
    whole = F.aggregate(F.coalesce("marks", F.array().cast("array<struct<at:int,rank:int,goes_on:int,mark:string>>")), start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.lit(2**30))))
    neat = F.regexp_replace(F.regexp_replace(whole, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return joined.select("doc_id", F.concat(F.regexp_replace(neat, r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def section_pages(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections ``doc_id, ord, start, end`` with ``page_start`` and ``page_end``: the pages that their spans touch."""
    t, p = tree.alias("t"), pages.select("doc_id", "page_no", F.col("char_start").alias("ps"), F.col("char_end").alias("pe")).alias("p")
    met = t.join(p, (F.col("t.doc_id") == F.col("p.doc_id")) & (F.col("p.pe") > F.col("t.start")) & (F.col("p.ps") < F.col("t.end")))
    ends = met.groupBy(F.col("t.doc_id").alias("doc_id"), F.col("t.ord").alias("ord")).agg(F.min("p.page_no").alias("page_start"), F.max("p.page_no").alias("page_end"))
    return tree.join(ends, ["doc_id", "ord"], "left")


def assemble_pages(items: DataFrame) -> DataFrame:
    """Pages from the items ``doc_id, page_no, item_no, text, ends_line`` of a parser: ``doc_id, page_no, text, char_start, char_end``,
    texts joined in order with a line break where an item ends a line, pages joined by a blank line, offsets in UTF-16 units."""
    piece = F.concat("text", F.when(F.col("ends_line"), F.lit("\n")).otherwise(""))
    rows = items.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("item_no", piece.alias("t")))).alias("i"))
    from .cleaning import assemble

    pages = rows.select("doc_id", "page_no", F.array_join(F.transform("i", lambda x: x["t"]), "").alias("text"))
    return pages.join(assemble(pages), ["doc_id", "page_no"])


def title_of(title, path):
    """A document's title, or the name of its file without folder and ending where it has none."""
    stem = F.regexp_replace(F.element_at(F.split(path, r"[/\\\\]"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), stem)
