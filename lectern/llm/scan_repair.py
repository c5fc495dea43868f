"""Noise in text from scanned pages (problem 5).

Every line of a page is labelled header or footer (``R``), page number (``P``) or body (``B``) by a linear conditional random
field over layout features: on how many pages of its document the same wording, or a page number at the same distance, stands;
whether all lines between it and an edge of the page may be running lines too; decorations, closing marks, blank lines and page
numbers next to it; likeness to the title.  Blank lines are breaks (``K``).  The field is fitted on at most SAMPLE_PAGES pages of the
collection, the first by a hash: steady repeats at an edge are running lines, steady numbers are page numbers, lines inside a page that
repeat nowhere are body; a first fit takes pages on which that settles every line, a second one all of them.  Paragraphs are put
together from the body lines.

Words are judged by counts over the whole collection.  A word that ends a line with a hyphen goes on in the next body line,
over a page break too; the hyphen is noise unless the hyphenated spelling is what the collection uses.  A word that the
collection's clean documents do not have, and that one or two typical confusions of a scanner turn into one they do have, is
misread (one confusion only in words under six or over sixty letters; a word counts as the collection's from MIN_COUNT uses on).

Counts of wordings are gathered as numbers for each document, and words as rows of their own, so no document, however
many pages it has, and no vocabulary is gathered in one task but for the final text of a document.  What a word may stand for is
tried against a filter of the vocabulary's hashes, of bounded size, before anything is shuffled.

Results for odd input: null page texts have no lines; pages without lines or with blank lines give no rows; documents
without a row in the documents table, or whose ``scanned`` is null, are not scanned; a page delivered twice gives its rows once;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import join_side, materialize
from . import crf

MIN_COUNT = 3
#: Bound of the sample that the field is fitted on.
SAMPLE_PAGES = 600
SEED = 23
#: Bits of the vocabulary's filter, as powers of two: 16 for each word within these bounds (at most 64 MB).
FILTER_BITS = (16, 29)
#: How a scanner misreads: what is seen, and what is printed.
CONFUSIONS = (
    ("rn", "m"), ("cl", "d"), ("ii", "u"), ("ii", "ü"), ("ri", "n"), ("li", "h"), ("h", "li"), ("ct", "a"), ("vv", "w"), ("c", "e"), ("e", "c"), ("i", "r"),
    ("5", "s"), ("6", "b"), ("6", "é"), ("q", "g"), ("f", "t"), ("l", "i"), ("1", "l"), ("1", "i"), ("i", "l"), ("0", "o"), ("8", "b"), ("9", "g"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("m", "rn"), ("d", "cl"),
)
#: Words after which a hyphen at a line's end stands for a word that is left out ("pre- and post-").
SUSPENDED = ("and", "or", "und", "oder", "et", "ou", "y", "o", "e", "en", "of")
HYPHENS = "-‐‑¬­"
_HYPHEN_SET = frozenset(HYPHENS)

_NUMBER = r"(?:[0-9lIoOSBZ|]{1,7}|[ivxlcdmIVXLCDM1]{1,15})"
_PAGE_WORDS = r"(?:page|pagc|paqe|p|pp|pg|seite|s|página|pagina|pág|pag|bladzijde|blz)"
_PAGE_NUMBER = re.compile(rf"^[\W_]*(?:{_PAGE_WORDS}\b[.:]?\s*)?({_NUMBER})(?:\s*(?:/|of|von|de|sur|van)\s*[0-9lIoOSBZ|]{{1,7}})?[\W_]*$", re.I)
_OUTER = re.compile(rf"^\s*({_NUMBER})\s{{2,}}\S|\S\s{{2,}}({_NUMBER})\s*$")
_DIGITS = str.maketrans("lI|oOSBZ", "11100582")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_LEFT = re.compile(rf"(\w+(?:-\w+)*)([{HYPHENS}])\s*$")
_RIGHT = re.compile(r"^\s*(\w+(?:[-‐]\w+)*)")
_HEADING = re.compile(r"^\s*\d+(?:\.\d+)*\.?\s\S")
_NO_LETTER = re.compile(r"[\W_2-47-9]+")
_AT_ENDS = re.compile(r"^\S{1,7}\s{2,}|\s{2,}\S{1,7}$")
_INNER_END = re.compile(r"[a-zà-ÿ0-9)][.!?]\s+\S")
_FOLD_ONE = str.maketrans({"c": "e", "1": "l", "i": "l", "r": "l", "5": "s", "6": "b", "q": "g", "f": "t", "0": "o", "ä": "a", "ö": "o", "ü": "u", "é": "b"})


def page_number_value(token: str) -> tuple[str, int] | None:
    """Kind and value of a printed page number, read through its likely misreadings."""
    low = token.lower()
    if re.fullmatch(r"[ivxlcdm]+", low) and not re.fullmatch(r"[l|]+", token):
        total = last = 0
        for c in reversed(low):
            n = _ROMAN[c]
            total += n if n >= last else -n
            last = max(last, n)
        return ("r", total)
    digits = token.translate(_DIGITS)
    return ("n", int(digits)) if digits.isdigit() and (any(c.isdigit() for c in token) or token in ("l", "I", "ll")) else None


def wording(line: str) -> str:
    """The letters of a line as far as misreading leaves them alone: what is often confused is one symbol."""
    s = _NO_LETTER.sub("", line.lower()).translate(_FOLD_ONE)
    for a, b in (("ll", "u"), ("ln", "m"), ("el", "d"), ("vv", "w"), ("et", "a")):
        s = s.replace(a, b)
    return s.replace("h", "u").replace("n", "u")


def _printed_number(line: str) -> str | None:
    """The number of a line that is nothing else."""
    text = line.strip()
    m = _PAGE_NUMBER.match(text)
    return m.group(1) if m else None


def _outer_number(line: str) -> str | None:
    """A number set apart at either end of a line."""
    text = line.strip()
    m = _OUTER.search(text) if "  " in text or "\t" in text else None
    return (m.group(1) or m.group(2)) if m else None


def _broken_end(line: str):
    """Match of the word and hyphen that end a line."""
    return _LEFT.search(line) if line.rstrip()[-1:] in _HYPHEN_SET else None


LABELS = ("B", "R", "P")
FEATURES = (
    "bias", "repeated_run", "repeated_more_run", "repeated_inside", "outer_number", "title", "closed", "sentence", "lower", "heading", "outermost", "second",
    "deep", "alone", "by_number", "number", "steady", "decorated", "number_closed",
)


def line_keys(text: str, page_no: int) -> tuple[int | None, int | None, str | None, str]:
    """What may repeat over the pages of a document: the wording and a page number's distance to the page's place, each as a number; the
    page number, if the line is one; and the wording."""
    own = wording(text)
    cut = wording(_AT_ENDS.sub("", text)) if "  " in text or "\t" in text else own
    digit = any(c.isdigit() or c in "ivxlcdmIVXLCDMOSBZ|" for c in text[:12] + text[-12:])
    token = _printed_number(text) if digit else None
    outer = token or (_outer_number(text) if digit else None)
    value = page_number_value(outer) if outer else None
    number = token if value and token else None
    distance = xxhash.xxh64_intdigest(f"{value[0]}{value[1] - page_no}") >> 1 if value else None
    return xxhash.xxh64_intdigest(cut) >> 1 if len(cut) >= 4 else None, distance, number, own


def page_features(lines: list[str], page_no: int, support: dict[int, int], title: str | None) -> tuple[list[int], list[list[float]], list[str | None]]:
    """Of the lines that are not blank: their places, features and what the collection itself says of them (a label, or null where
    it leaves it open).  ``support`` counts the pages of the document that have a key."""
    solid = [i for i, l in enumerate(lines) if l.strip()]
    n = len(solid)
    texts = [lines[i].strip() for i in solid]
    keys = [line_keys(t, page_no) for t in texts]
    repeats = [support.get(k[0], 1) if k[0] is not None else 1 for k in keys]
    steady = [(support.get(k[1], 1) if k[1] is not None else 1) >= 2 for k in keys]
    numbers = [k[2] is not None for k in keys]
    may = [r >= 2 or m or s for r, m, s in zip(repeats, numbers, steady)]
    top = next((i for i, m in enumerate(may) if not m), n)
    bottom = next((i for i, m in enumerate(reversed(may)) if not m), n)
    titled = wording(title or "")
    rows, says = [], []
    for j, text in enumerate(texts):
        i, r = solid[j], repeats[j]
        run = j <= top or j >= n - 1 - bottom
        depth = min(j, n - 1 - j)
        own = keys[j][3]
        closed = text[-1] in ".!?;,…" or _broken_end(text) is not None
        sentence = bool(_INNER_END.search(text))
        outer = steady[j] and not numbers[j]
        alone = i == 0 or i + 1 == len(lines) or not lines[i - 1].strip() or not lines[i + 1].strip()
        if numbers[j]:
            rows.append([1.0, *[0.0] * 9, float(depth == 0), float(depth == 1), float(depth > 1), 0.0, 0.0, 1.0, float(steady[j]), float(not text[0].isdigit() or not text[-1].isalnum()), float(text[-1] in ".,;")])
            closed = text[-1] in ".,;"
            says.append("P" if steady[j] and run and not closed else "B" if closed and support.get(keys[j][1], 1) < 3 else None)
            continue
        like_title = len(titled) >= 8 and len(own) >= 8 and (titled.startswith(own) or own.startswith(titled))
        beside = (j > 0 and numbers[j - 1] and depth <= 1) or (j + 1 < n and numbers[j + 1] and depth <= 1)
        rows.append(
            [
                1.0, float(run and r >= 2), float(run and r >= 3), float(not run and r >= 2), float(outer), float(like_title), float(closed), float(sentence),
                float(text[0].islower() and r < 3), float(not steady[j] and bool(_HEADING.match(lines[i]))), float(depth == 0), float(depth == 1), float(depth > 1),
                float(alone), float(beside), 0.0, 0.0, 0.0, 0.0,
            ]
        )
        if run and (r >= 3 and not closed or outer and own):
            says.append("R")
        elif r == 1 and not outer and not like_title and (depth > 1 or closed or sentence or text[0].islower()):
            says.append("B")
        else:
            says.append(None)
    return solid, rows, says


#: Lines as the model expects them where a collection has too few pages to say: features that hold, and the label.
_BY_HAND = (
    ("repeated_run repeated_more_run outermost alone", "R"), ("repeated_run outermost alone", "R"), ("repeated_run repeated_more_run second", "R"), ("outer_number outermost alone", "R"),
    ("outer_number repeated_run outermost", "R"), ("title outermost alone", "R"), ("outermost closed", "B"), ("outermost lower closed", "B"), ("outermost heading alone", "B"), ("outermost", "B"),
    ("second closed", "B"), ("second", "B"), ("deep", "B"), ("deep closed", "B"), ("deep repeated_inside", "B"), ("deep repeated_inside closed", "B"), ("repeated_run closed outermost", "B"), ("repeated_run closed sentence outermost", "B"),
    ("number steady outermost", "P"), ("number steady decorated outermost", "P"), ("number steady second", "P"), ("number deep", "B"), ("number number_closed deep", "B"), ("number outermost decorated", "P"), ("by_number repeated_run second", "R"),
)


def fit_lines(pages: list[tuple[list[list[float]], list[str | None]]]) -> crf.Chain:
    """The field, from pages as :func:`page_features` gives them."""
    hand = [([[float(f == "bias" or f in names.split()) for f in FEATURES]], [label]) for names, label in _BY_HAND]
    # the examples stand for single lines and weigh little against the pages
    pages = [(rows, says) for rows, says in pages if rows]
    sure = [*hand, *((rows, says) for rows, says in pages if None not in says)]

    def fit(sequences: list, begin: crf.Chain | None = None, rounds: int = 100) -> crf.Chain:
        rows = np.array([r for rows, _ in sequences for r in rows])
        tags = [LABELS.index(l) for _, says in sequences for l in says]
        return crf.fit(crf.Rows(rows, [[] for _ in rows]), [len(s) for _, s in sequences], tags, LABELS, 1, rounds, begin=begin)

    first = fit(sure)
    rest = [(rows, says) for rows, says in pages if None in says]
    if not rest:
        return first
    lengths = [len(s) for _, s in rest]
    guess = crf.decode(crf.scores(first, crf.Rows(np.array([r for rows, _ in rest for r in rows]), [[] for _ in range(sum(lengths))])), lengths, first)
    told, k = [], 0
    for rows, says in rest:
        told.append((rows, [l or LABELS[guess[k + i]] for i, l in enumerate(says)]))
        k += len(says)
    return fit([*sure, *told], first, 60)


def label_pages(chain: crf.Chain, pages: list[tuple[list[str], int, dict[int, int], str | None]]) -> list[str]:
    """One label for each line of each page."""
    found = [page_features(*p) for p in pages]
    rows = [r for _, rows, _ in found for r in rows]
    lengths = [len(solid) for solid, _, _ in found]
    tags = crf.decode(crf.scores(chain, crf.Rows(np.array(rows), [[] for _ in rows])), lengths, chain) if rows else []
    out, k = [], 0
    for (lines, *_), (solid, _, _) in zip(pages, found):
        labels = ["K"] * len(lines)
        for i in solid:
            labels[i] = LABELS[tags[k]]
            k += 1
        out.append("".join(labels))
    return out


def misreadings(word: str, steps: int = 2) -> list[tuple[str, int]]:
    """What may be printed where ``word`` is seen, with the number of confusions."""
    done = {word: 0}
    front = [word]
    for step in range(1, steps + 1):
        fresh = []
        for w in front:
            for seen, printed in CONFUSIONS:
                i = w.find(seen)
                while i >= 0:
                    c = w[:i] + printed + w[i + len(seen) :]
                    if c not in done:
                        done[c] = step
                        fresh.append(c)
                    i = w.find(seen, i + 1)
        front = fresh
    return list(done.items())


def scanned_pages(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """``doc_id, page_no, text, title`` of the pages of scanned documents."""
    scanned = join_side(parsed.filter(F.col("scanned")).select("doc_id", "title").dropDuplicates(["doc_id"]))
    return pages.select("doc_id", "page_no", "text").filter(F.col("text").isNotNull()).join(scanned, "doc_id").dropDuplicates(["doc_id", "page_no"])


def labelled_pages(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """``doc_id, page_no, text, labels, joins, skips, head_line, head_word``: a label for each line, the words that go on in a
    later line, and the page's first body word, for a word broken at the end of the page before."""
    spark = pages.sparkSession
    scanned = materialize(scanned_pages(pages, parsed).withColumn("doc", F.xxhash64("doc_id")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [sorted({k for l in text.split("\n") if (t := l.strip()) for k in line_keys(t, int(no))[:2] if k is not None}) for no, text in zip(b["page_no"], b["text"])]
            yield pd.DataFrame({"doc": b["doc"], "page_no": b["page_no"], "keys": keys})

    keys = materialize(scanned.select("doc", "page_no", "text").mapInPandas(read, "doc bigint, page_no int, keys array<bigint>"))
    each = keys.select("doc", "page_no", F.explode("keys").alias("key"))
    counts = each.groupBy("doc", "key").agg(F.count("*").cast("int").alias("n")).filter("n > 1")
    known = each.join(counts, ["doc", "key"]).groupBy("doc", "page_no").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("support"))
    known = materialize(known)
    order = F.xxhash64("doc", "page_no", F.lit(SEED))
    some = scanned.orderBy(order, "doc_id", "page_no").limit(SAMPLE_PAGES).join(known, ["doc", "page_no"], "left").select("doc_id", "page_no", "text", "title", "support").toPandas()
    page = lambda no, text, title, support: (text.split("\n"), int(no), dict(support) if support is not None else {}, title)
    some = some.sort_values(["doc_id", "page_no"])
    model = fit_lines([page_features(*page(*r))[1:] for r in zip(some["page_no"], some["text"], some["title"], some["support"])])
    shared = spark.sparkContext.broadcast(model)
    both = scanned.join(known, ["doc", "page_no"], "left").select("doc_id", "page_no", "text", "title", "support")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            every = label_pages(shared.value, [page(*r) for r in zip(b["page_no"], b["text"], b["title"], b["support"])])
            for doc, no, text, labels in zip(b["doc_id"], b["page_no"], b["text"], every):
                lines = text.split("\n")
                body = [i for i, l in enumerate(labels) if l == "B"]
                skips, joins = ["0"] * len(lines), []
                for j, i in enumerate(body):
                    m = _broken_end(lines[i])
                    if not m or m.group(1)[-1].isdigit():
                        continue
                    skips[i] = str(int(skips[i]) | 2)
                    nxt = body[j + 1] if j + 1 < len(body) else -1
                    r = _RIGHT.match(lines[nxt]) if nxt >= 0 else None
                    if r:
                        skips[nxt] = str(int(skips[nxt]) | 1)
                    joins.append({"line": i, "left": m.group(1).lower(), "mark": m.group(2), "to_line": nxt, "right": r.group(1).lower() if r else None})
                first = _RIGHT.match(lines[body[0]]) if body else None
                rows.append((doc, no, text, labels, joins, "".join(skips), body[0] if first else -1, first.group(1).lower() if first else None))
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "labels", "joins", "skips", "head_line", "head_word"])

    joins = "array<struct<line:int,left:string,mark:string,to_line:int,right:string>>"
    return materialize(both.mapInPandas(run, f"doc_id string, page_no int, text string, labels string, joins {joins}, skips string, head_line int, head_word string"))


def clean_vocabulary(parsed: DataFrame) -> DataFrame:
    """``word, n``: words and hyphenated words of the documents that are not scanned, by their counts."""
    text = parsed.filter(~F.coalesce("scanned", F.lit(False))).select(F.lower("text").alias("t"))
    words = text.select(F.explode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # a hyphenated word counts as such and by its parts
    parts = F.when(F.contains("w", F.lit("-")), F.array_append(F.split("w", "-"), F.col("w"))).otherwise(F.array("w"))
    return words.select(F.explode(parts).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


@dataclass(frozen=True)
class WordFilter:
    """Two bits for each word of a vocabulary: words without both are surely not in it."""

    bits: int
    blocks: dict[int, bytes]

    def __contains__(self, word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return self._set(h & (self.bits - 1)) and self._set((h >> 32) & (self.bits - 1))

    def _set(self, at: int) -> bool:
        block = self.blocks.get(at >> 16)
        return block is not None and bool(block[(at & 0xFFFF) >> 3] >> (at & 7) & 1)


def word_filter(vocabulary: DataFrame) -> WordFilter:
    """The filter of a materialized vocabulary; the driver gets at most 2 ** FILTER_BITS[1] bits, whatever the number of words."""
    bits = 1 << min(FILTER_BITS[1], max(FILTER_BITS[0], (16 * vocabulary.count()).bit_length()))
    h = F.xxhash64("word")
    places = vocabulary.select(F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("at")).distinct()

    def join(b: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros(1 << 16, dtype=np.uint8)
        field[(b["at"] & 0xFFFF).to_numpy()] = 1
        return pd.DataFrame({"block": [int(b["block"].iloc[0])], "bits": [np.packbits(field, bitorder="little").tobytes()]})

    blocks = places.select(F.shiftright("at", 16).cast("int").alias("block"), "at").groupBy("block").applyInPandas(join, "block int, bits binary").toPandas()
    return WordFilter(bits, dict(zip(blocks["block"].tolist(), blocks["bits"].tolist())))


def _readings(items: DataFrame, vocabulary: DataFrame, known: WordFilter) -> DataFrame:
    """``key, role, steps, n, reading``: of every (key, role, word) the reading with fewest confusions that the
    vocabulary has, the most frequent of those."""
    shared = items.sparkSession.sparkContext.broadcast(known)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            rows = [
                (k, role, c, s)
                for k, role, w in zip(b["key"], b["role"], b["word"])
                for c, s in (misreadings(w, 1 if role == "compound" or not 6 <= len(w) <= 60 else 2) if role in ("word", "joined", "compound") else [(w, 0)])
                if c in known
            ]
            yield pd.DataFrame(rows, columns=["key", "role", "word", "steps"])

    tried = items.mapInPandas(spread, "key string, role string, word string, steps int")
    hit = tried.join(vocabulary, "word").groupBy("key", "role").agg(F.min(F.struct("steps", (-F.col("n")).alias("minus"), F.col("word").alias("reading"))).alias("best"))
    return hit.select("key", "role", "best.steps", (-F.col("best.minus")).alias("n"), "best.reading")


def _line_words(labelled: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no, word``: the words of body lines, without those that are parts of a broken word."""
    lines = labelled.select("doc_id", "page_no", "labels", "skips", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.filter(F.substring("labels", F.col("line_no") + 1, F.lit(1)) == "B").withColumn("skip", F.substring("skips", F.col("line_no") + 1, F.lit(1)).cast("int"))
    words = F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    first = F.when(F.col("skip").bitwiseAND(1) > 0, 2).otherwise(1)
    left = F.greatest(F.size("words") - first + 1 - F.when(F.col("skip").bitwiseAND(2) > 0, 1).otherwise(0), F.lit(0))
    rows = lines.select("doc_id", "page_no", "line_no", "skip", words.alias("words"))
    return rows.select("doc_id", "page_no", "line_no", F.explode(F.slice("words", first, left)).alias("word"))


def broken_words(labelled: DataFrame, vocabulary: DataFrame, known: WordFilter) -> DataFrame:
    """Every word that ends a line with a hyphen: ``doc_id, page_no, line_no, to_page, to_line, left, right, noise, reading, steps``."""
    ends = labelled.select("doc_id", "page_no", F.explode("joins").alias("j")).select("doc_id", "page_no", "j.*")
    heads = labelled.filter(F.col("head_line") >= 0).select("doc_id", (F.col("page_no") - 1).alias("page_no"), "head_line", "head_word")
    ends = ends.join(heads, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no", F.col("line").alias("line_no"), "left", "mark",
        F.when(F.col("to_line") >= 0, F.col("page_no")).otherwise(F.col("page_no") + 1).alias("to_page"),
        F.when(F.col("to_line") >= 0, F.col("to_line")).otherwise(F.col("head_line")).alias("to_line"),
        F.when(F.col("to_line") >= 0, F.col("right")).otherwise(F.col("head_word")).alias("right"),
    )
    ends = materialize(ends.filter(F.col("right").isNotNull()))
    key = F.concat_ws("\u0001", "left", "right")
    pairs = ends.select(key.alias("key"), "left", "right").distinct()
    last, first = F.element_at(F.split("left", "-"), -1), F.element_at(F.split("right", "[-‐]"), 1)
    roles = F.array(
        F.struct(F.lit("joined").alias("role"), F.concat(last, first).alias("word")),
        F.struct(F.lit("compound").alias("role"), F.concat_ws("-", "left", "right").alias("word")),
        F.struct(F.lit("compound2").alias("role"), F.concat_ws("-", last, first).alias("word")),
        F.struct(F.lit("left").alias("role"), last.alias("word")),
        F.struct(F.lit("right").alias("role"), first.alias("word")),
    )
    found = _readings(pairs.select("key", F.explode(roles).alias("r")).select("key", "r.role", "r.word"), vocabulary, known)
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    told = found.groupBy("key").agg(
        of("joined", "steps").alias("steps"), of("joined", "n").alias("joined_n"), of("joined", "reading").alias("reading"),
        F.greatest(of("compound", "n"), of("compound2", "n")).alias("compound_n"), of("left", "n").alias("left_n"), of("right", "n").alias("right_n"),
    )
    judged = ends.withColumn("key", key).join(told, "key", "left")
    exact = (F.col("steps") == 0) & (F.col("joined_n") >= F.coalesce("compound_n", F.lit(0)))
    suspended = F.col("right").isin(*SUSPENDED)
    noise = (
        F.when(F.col("mark").isin("¬", "­"), F.lit(True))
        .when(exact, F.lit(True))
        .when(F.col("compound_n").isNotNull() | suspended, F.lit(False))
        .when(F.col("steps").isNotNull(), F.lit(True))
        .otherwise(~(F.col("left_n").isNotNull() & F.col("right_n").isNotNull()))
    )
    return judged.withColumn("noise", noise).drop("key", "joined_n", "compound_n", "left_n", "right_n")


def word_fixes(labelled: DataFrame, vocabulary: DataFrame, known: WordFilter) -> DataFrame:
    """``word, reading`` of the words that the vocabulary lacks but for a misreading, each once; not words of figures only."""
    words = _line_words(labelled).select("word").filter(F.rlike("word", F.lit(r"\p{L}"))).distinct().join(vocabulary, "word", "left_anti")
    found = _readings(words.select(F.col("word").alias("key"), F.lit("word").alias("role"), "word"), vocabulary, known)
    figures = words.filter(F.rlike("word", F.lit(r"^[lo]*\d[\dlo]*$|^\d+[lo]+\d*$"))).select("word", F.translate("word", "lo", "10").alias("reading"))
    fixes = found.select(F.col("key").alias("word"), "reading")
    return fixes.unionByName(figures.join(fixes, "word", "left_anti"))


def noisy_lines(pages: DataFrame, parsed: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, page_no, line_no, noise`` of every noisy line of scanned documents."""
    labelled = labelled_pages(pages, parsed) if labelled is None else labelled
    vocabulary = materialize(clean_vocabulary(parsed))
    known = word_filter(vocabulary)
    letters = F.split("labels", "")
    kinds = labelled.select("doc_id", "page_no", F.posexplode(letters).alias("line_no", "label")).filter(F.col("label").isin("R", "P"))
    edges = kinds.select("doc_id", "page_no", "line_no", F.when(F.col("label") == "R", "running").otherwise("page_number").alias("noise"))
    broken = materialize(broken_words(labelled, vocabulary, known).filter("noise"))
    hyphens = broken.select("doc_id", "page_no", "line_no", F.lit("hyphen").alias("noise"))
    misread = _line_words(labelled).join(join_side(word_fixes(labelled, vocabulary, known)), "word").select("doc_id", "page_no", "line_no")
    # a broken word is misread where its reading departs from what the line shows
    torn = broken.filter(F.col("steps") > 0)
    here = F.startswith("reading", F.element_at(F.split("left", "-"), -1))
    parts = torn.select("doc_id", F.when(here, F.col("to_page")).otherwise(F.col("page_no")).alias("page_no"), F.when(here, F.col("to_line")).otherwise(F.col("line_no")).alias("line_no"))
    words = misread.unionByName(parts).distinct().withColumn("noise", F.lit("misread"))
    return edges.unionByName(hyphens).unionByName(words).select("doc_id", F.col("page_no").cast("int"), F.col("line_no").cast("int"), "noise")


def repaired_documents(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """``doc_id, text, paragraphs``: body lines as paragraphs, words joined and misread words spelled as the collection does."""
    labelled = labelled_pages(pages, parsed)
    vocabulary = materialize(clean_vocabulary(parsed))
    known = word_filter(vocabulary)
    fixes = join_side(word_fixes(labelled, vocabulary, known))
    broken = materialize(broken_words(labelled, vocabulary, known).filter("noise"))
    changes = _line_words(labelled).join(fixes, "word").groupBy("doc_id", "page_no", "line_no").agg(F.collect_set(F.struct("word", "reading")).alias("fixes"))
    left = broken.select("doc_id", "page_no", "line_no", F.coalesce("reading", F.concat("left", "right")).alias("whole"), F.lit(True).alias("joined"))
    taken = broken.select("doc_id", F.col("to_page").alias("page_no"), F.col("to_line").alias("line_no"), F.lit(True).alias("taken")).distinct()
    lines = labelled.select("doc_id", "page_no", "labels", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("label", F.substring("labels", F.col("line_no") + 1, F.lit(1))).drop("labels").filter(F.col("label").isin("B", "K"))
    at = ["doc_id", "page_no", "line_no"]
    rich = lines.join(changes, at, "left").join(left, at, "left").join(taken, at, "left")
    per_page = rich.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "label", "line", "fixes", "whole", "joined", "taken"))).alias("lines"))
    per_doc = per_page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "lines"))).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, pages_ in zip(b["doc_id"], b["pages"]):
                lines = [l for p in pages_ for l in p["lines"]]
                text = assemble_paragraphs(lines)
                rows.append((doc, text, text.count("\n\n") + 1 if text else 0))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "paragraphs"])

    return per_doc.mapInPandas(run, "doc_id string, text string, paragraphs int")


def _as_printed(seen: str, reading: str) -> str:
    return reading.upper() if seen.isupper() and len(seen) > 1 else reading[:1].upper() + reading[1:] if seen[:1].isupper() else reading


def assemble_paragraphs(lines: list) -> str:
    """Paragraphs of the body lines in order: a blank line, an indent or a numbered heading starts another."""
    out: list[str] = []
    fresh = True
    for l in lines:
        line = l["line"]
        if l["label"] == "K":
            fresh = True
            continue
        body = line.strip()
        for f in l["fixes"] if l["fixes"] is not None else []:
            body = re.sub(rf"(?<!\w){re.escape(f['word'])}(?!\w)", lambda m, r=f["reading"]: _as_printed(m.group(), r), body, flags=re.I)
        if l["taken"]:
            body = re.sub(r"^\w+", "", body, count=1)
        closed = not out or out[-1].endswith((".", "!", "?", "…", ":", "\u0000"))
        heading = closed and bool(_HEADING.match(line)) and not body.endswith((".", ","))
        if l["joined"]:
            m = _broken_end(body)
            if m:
                start = m.group(1).rpartition("-")[0]
                seen = m.group(1).rpartition("-")[2]
                body = body[: m.start()] + (start + "-" if start else "") + _as_printed(seen, str(l["whole"]))
        # a hyphen that belongs to its word goes on without a space, one that stands for a left-out word does not
        first = _RIGHT.match(body)
        held = bool(out) and _broken_end(out[-1]) is not None and first is not None and first.group(1).lower() not in SUSPENDED
        glue = "" if l["taken"] or held else " "
        indent = line[:2].isspace()
        # after a blank line text goes on in the same paragraph only if no sentence had ended (a page break)
        if out and (not fresh or not out[-1].endswith((".", "!", "?", "…", ":"))) and not heading and not (indent and out[-1].endswith((".", "!", "?"))) and not out[-1].endswith("\u0000"):
            out[-1] = out[-1] + glue + body
        else:
            out.append(body)
        if heading:
            out[-1] += "\u0000"
        fresh = False
    return "\n\n".join(p.rstrip("\u0000") for p in out)
