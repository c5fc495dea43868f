"""What a reader sees: answers cut at their citation marks, boxes around cited passages, places in the outline, what became of a
candidate, and the comparison of two extractions of one document."""

from __future__ import annotations

from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import utf16_units

#: How far a line reaches above and below its baseline, when two boxes are on one line, and how near they must be (fixed values).
ASCENT, DESCENT, SAME_LINE, JOIN_GAP = 0.95, 0.25, 0.4, 0.9
_MARK = r"\[\d+(?:\s*,\s*\d+)*\]"


def answer_segments(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, place, kind, text, numbers``: an answer as text and citation marks in order; joined they give it back."""
    texts, marks = F.split(text_col, _MARK), F.regexp_extract_all(text_col, F.lit(f"({_MARK})"), F.lit(1))
    numbers = lambda m: F.transform(F.split(F.translate(m, "[] ", ""), ","), lambda n: F.trim(F.regexp_replace(n, r"\s", "")).cast("bigint"))
    none = F.lit(None).cast("array<bigint>")
    text = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), none.alias("numbers"))
    cite = lambda m: F.struct(F.lit("cite").alias("kind"), m.alias("text"), numbers(m).alias("numbers"))
    pairs = F.flatten(F.transform(texts, lambda t, i: F.when(i < F.size(marks), F.array(text(t), cite(F.get(marks, i)))).otherwise(F.array(text(t)))))
    rows = answers.filter(F.length(text_col) > 0).select(F.col(id_col), F.posexplode(F.filter(pairs, lambda s: s["text"] != "")).alias("place", "s"))
    return rows.select(id_col, "place", "s.kind", "s.text", "s.numbers")


def highlight_boxes(items: DataFrame, spans: DataFrame) -> DataFrame:
    """``span_id, doc_id, page_no, line_no, x, y, width, height``: a band for each line of a passage ``span_id, doc_id, start, end``.

    Items ``doc_id, page_no, item_no, x, y, width, font_size, start, end`` are taken as evenly spaced text.  A task holds one passage's
    items on one page."""
    i, s = items.alias("i"), spans.alias("s")
    met = i.join(s, (F.col("i.doc_id") == F.col("s.doc_id")) & (F.col("i.start") < F.col("s.end")) & (F.col("s.start") < F.col("i.end")) & (F.col("i.width") > 0) & (F.col("i.font_size") > 0))
    length = (F.col("i.end") - F.col("i.start")).cast("double")
    left = (F.greatest("i.start", "s.start") - F.col("i.start")) / length
    right = (F.least("i.end", "s.end") - F.col("i.start")) / length
    pieces = met.select(
        "s.span_id", "i.doc_id", "i.page_no", "i.item_no", (F.col("i.x") + F.col("i.width") * left).alias("x"), (F.col("i.y") - F.col("i.font_size") * DESCENT).alias("y"),
        (F.col("i.width") * (right - left)).alias("width"), (F.col("i.font_size") * (ASCENT + DESCENT)).alias("height"), F.col("i.font_size").alias("size"),
    )
    key = items.schema["doc_id"].dataType.simpleString(), spans.schema["span_id"].dataType.simpleString()

    def join_lines(page: pd.DataFrame) -> pd.DataFrame:
        bands: list[list[float]] = []  # left, bottom, right, top
        for p in page.sort_values("item_no").itertuples():
            box = [p.x, p.y, p.x + p.width, p.y + p.height]
            if bands:
                b = bands[-1]
                level = abs(b[1] - p.y) <= SAME_LINE * p.size
                if level and b[0] - p.size <= p.x <= b[2] + JOIN_GAP * p.size:
                    bands[-1] = [min(b[0], box[0]), min(b[1], box[1]), max(b[2], box[2]), max(b[3], box[3])]
                    continue
            bands.append(box)
        first = page.iloc[0]
        return pd.DataFrame([(first.span_id, first.doc_id, first.page_no, n, a, b, c - a, d - b) for n, (a, b, c, d) in enumerate(bands)], columns=["span_id", "doc_id", "page_no", "line_no", "x", "y", "width", "height"])

    return pieces.groupBy("span_id", "doc_id", "page_no").applyInPandas(join_lines, f"span_id {key[1]}, doc_id {key[0]}, page_no int, line_no int, x double, y double, width double, height double")


def outline_keys(tree: DataFrame) -> DataFrame:
    """Sections with ``key``, their places from the top joined by points (``2.0`` is the first part of the third chapter).

    ``tree`` holds ``doc_id, ord, parent_ord, level``; a level's keys build on those of the level above."""
    among = Window.partitionBy("doc_id", "parent_ord").orderBy("ord")
    placed = tree.withColumn("place", (F.row_number().over(among) - 1).cast("string"))
    done = placed.filter("parent_ord IS NULL").withColumn("key", F.col("place"))
    out, depth = done, int(tree.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])
    for level in range(2, depth + 1):  # as many steps as the outline has levels, six at most
        above = done.select("doc_id", F.col("ord").alias("parent_ord"), F.col("key").alias("above"))
        done = placed.filter(F.col("level") == level).join(above, ["doc_id", "parent_ord"]).withColumn("key", F.concat_ws(".", "above", "place")).drop("above")
        out = out.unionByName(done.select(out.columns))
    return out.drop("place")


def active_trail(tree: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, level, title``: at each level the last section that holds a page, within the one above.

    ``tree`` holds ``doc_id, ord, parent_ord, level, title, page_start, page_end``."""
    t, p = tree.alias("t"), pages.select("doc_id", "page_no").distinct().alias("p")
    held = t.join(p, (F.col("t.doc_id") == F.col("p.doc_id")) & (F.col("t.page_start") <= F.col("p.page_no")) & (F.col("p.page_no") <= F.col("t.page_end")))
    held = held.select("p.doc_id", "p.page_no", "t.ord", "t.parent_ord", "t.level", "t.title")
    depth = int(tree.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0])
    last = lambda df: df.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("ord", "level", "title"), "ord").alias("b")).select("doc_id", "page_no", "b.*")
    step = last(held.filter("parent_ord IS NULL"))
    out = step
    for _ in range(1, depth):
        above = step.select("doc_id", "page_no", F.col("ord").alias("parent_ord"))
        step = last(held.join(above, ["doc_id", "page_no", "parent_ord"]))
        out = out.unionByName(step)
    return out.select("doc_id", "page_no", "level", "title")


def history_to_send(turns: DataFrame, conversation: str, order: str, last: int = 6, chars: int = 8000) -> DataFrame:
    """The last turns of a conversation that were finished, not refused and are not blank, texts cut to ``chars``.

    ``turns`` holds ``question, answer, finished, refusal``."""
    good = turns.filter(F.col("finished") & F.col("refusal").isNull() & F.rlike("answer", F.lit(r"\S")) & F.rlike("question", F.lit(r"\S")))
    recent = good.withColumn("back", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))).filter(F.col("back") <= last)
    return recent.select(conversation, order, F.substring("question", 1, chars).alias("question"), F.substring("answer", 1, chars).alias("answer"))


def rerank_moves(candidates: DataFrame) -> DataFrame:
    """Adds ``move`` (cut, same, up, down) to candidates with their ``rank`` before and ``final_rank`` after, null where cut."""
    after, before = F.col("final_rank"), F.col("rank")
    return candidates.withColumn("move", F.when(after.isNull(), "cut").when(after == before, "same").when(after < before, "up").otherwise("down"))


def budget_share(used, budget):
    """How much of a token budget is used, from 0 to 1; a budget of 0 is full."""
    return F.when(budget <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), used.cast("double") / budget)))


def _flat(column):
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def extractor_summary(pages: DataFrame, items: DataFrame | None = None, top: int = 5) -> DataFrame:
    """``doc_id, pages, empty_pages, chars, words`` of each document, and of its items their number, the bold ones, the fonts and the
    ``top`` sizes by characters; texts count as joined by a blank line."""
    words = F.when(_flat(F.col("text")) == "", 0).otherwise(F.size(F.split(_flat(F.col("text")), " ")))
    own = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.count_if(~F.rlike("text", F.lit(r"\S"))).alias("empty_pages"),
        (F.sum(utf16_units(F.col("text"))) + 2 * (F.count("*") - 1)).alias("chars"), F.sum(words).alias("words"),
    )
    if items is None:
        return own
    sizes = items.groupBy("doc_id", "font_size").agg(F.sum(utf16_units(F.col("text"))).alias("n"))
    ranked = sizes.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "font_size"))).filter(F.col("at") <= top)
    tops = ranked.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "font_size", "n"))), lambda s: F.struct(s["font_size"], s["n"])).alias("top_sizes"))
    fonts = items.groupBy("doc_id").agg(F.count("*").alias("items"), F.count_if("is_bold").alias("bold_items"), F.array_sort(F.collect_set("font_name")).alias("fonts"))
    return own.join(fonts, "doc_id", "left").join(tops, "doc_id", "left")


def page_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc_id, page_no, at, whitespace_only`` of pages that differ between two extractions: the first place that differs, in
    characters; a page that one side lacks is empty there."""
    both = a.select("doc_id", "page_no", F.col("text").alias("a")).join(b.select("doc_id", "page_no", F.col("text").alias("b")), ["doc_id", "page_no"], "full_outer").na.fill("", ["a", "b"])
    apart = both.filter(F.col("a") != F.col("b"))
    @F.pandas_udf("int")
    def first_apart(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([len(commonprefix([x, y])) for x, y in zip(one, other)], dtype="int32")

    return apart.select("doc_id", "page_no", first_apart("a", "b").alias("at"), (_flat(F.col("a")) == _flat(F.col("b"))).alias("whitespace_only"))
