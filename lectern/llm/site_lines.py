"""Lines that a site puts on its documents (problem 1).

Every line is parsed down token trees of fixed depth under its source.  Digits, marks, spaces and case take no part, so changing
numbers and decorations are wildcards from the start.  Three trees share one count:

* by letters (``l``): number of letters, first BLOCK letters, last BLOCK letters; the letters between are a wildcard slot.  Its
  leaves are the wordings.  As it reads letters and not words, a wording lies under one node however it is parted into words.
* by words from the front (``f``): number of words, first words, last word; and from the end (``e``): number of words, first word, last
  words; the words between are wildcard slots.  These give the templates of lines that differ in some words.

A document is one row, so each partition counts the documents of a node exactly in its partial aggregation, and merging the
trees of all partitions is adding counts.  Nodes that cover many documents of their source are followed: the lines under a
covering ``l`` node go on to its leaves, whose counts decide (a leaf covers no more documents than its node, so none is lost).
Finding and removing use the same leaves; removing can also take the lines of templates with enough fixed words.

Results for odd input: null texts have no lines; a null source is a source of its own; repeated lines of one document
count once for coverage and are all found; documents delivered twice under different ids count twice; lines with fewer
than six letters never count; documents whose ``scanned`` is null are left out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import join_side, materialize

MIN_LETTERS = 6
MIN_DOCUMENTS = 3
MIN_SHARE = 0.1
DEPTH = 3
BLOCK = 6
#: Share of a wildcard template's words that must be fixed for its lines to be removed.
MIN_FIXED = 0.6
#: Ways that the documents of a source are dealt where its marks are too many to broadcast.
SALTS = 64
_NO_SOURCE = "\u0000"


def _words(line):
    """Lower-case words of a line, one space between them; format characters vanish without parting a word."""
    spaced = F.regexp_replace(F.regexp_replace(line, r"\p{Cf}+", ""), r"\P{L}+", " ")
    return F.trim(F.replace(F.lower(spaced), F.lit("ß"), F.lit("ss")))


def _letters(words):
    return F.replace(words, F.lit(" "), F.lit(""))


def _leaf(letters):
    """A wording as a number."""
    return F.xxhash64(letters, F.length(letters))


def _letter_node(letters):
    return F.xxhash64(F.lit("l"), F.length(letters), F.substring(letters, 1, BLOCK), F.right(letters, F.lit(BLOCK)))


def _word_nodes(words):
    """The inner nodes at full depth: a tree read from the front and one read from the end, so that words which change
    at one end of a template leave its other end together."""
    parts = F.split(words, " ")
    front = F.xxhash64(F.lit("front"), F.size(parts), F.slice(parts, 1, DEPTH), F.element_at(parts, -1))
    tail = F.slice(parts, F.greatest(F.size(parts) - DEPTH + 2, F.lit(1)), DEPTH - 1)
    return F.array(front, F.xxhash64(F.lit("end"), F.size(parts), F.element_at(parts, 1), tail))


def _source(column):
    return F.coalesce(column, F.lit(_NO_SOURCE))


def _long_enough(words):
    return F.length(_letters(words)) >= MIN_LETTERS


def _plain_documents(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("scanned")).select("doc_id", _source(F.col("source")).alias("source"), "text")


def _covering(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``source, node, documents`` of the nodes, one row for each document under them, that cover enough of their source."""
    counted = nodes.groupBy("source", "node").agg(F.count("*").alias("documents")).filter(F.col("documents") >= MIN_DOCUMENTS)
    return counted.join(sizes, "source").filter(F.col("documents") >= MIN_SHARE * F.col("of_documents") - 1e-9).select("source", "node", "documents")


def _sizes(docs: DataFrame) -> DataFrame:
    return join_side(docs.groupBy("source").agg(F.count("*").alias("of_documents")))


def site_wordings(parsed: DataFrame) -> DataFrame:
    """``source, above, node, documents``: the leaves of the letter tree that cover at least MIN_DOCUMENTS and MIN_SHARE of the
    non-scanned documents of their source, each under its inner node ``above``."""
    docs = _plain_documents(parsed)
    lines = F.filter(F.transform(F.transform(F.split("text", "\n"), _words), _letters), lambda l: F.length(l) >= MIN_LETTERS)
    paths = F.array_distinct(F.transform(lines, lambda l: F.struct(_letter_node(l).alias("above"), _leaf(l).alias("node"))))
    # two numbers for each line: what both levels of the tree are counted from
    parsed_lines = materialize(docs.select("source", paths.alias("paths")))
    sizes = _sizes(parsed_lines)
    inner = parsed_lines.select("source", F.explode(F.array_distinct(F.transform("paths", lambda p: p["above"]))).alias("node"))
    followed = join_side(_covering(inner, sizes).select("source", F.col("node").alias("above")))
    under = parsed_lines.select("source", F.explode("paths").alias("p")).select("source", "p.above", "p.node").join(followed, ["source", "above"], "left_semi")
    leaves = _covering(under.select("source", F.struct("above", "node").alias("node")), sizes)
    return leaves.select("source", "node.above", "node.node", "documents")


def found_lines(pages: DataFrame, parsed: DataFrame) -> DataFrame:
    """``doc_id, page_no, line_no`` of every line that reaches a covering leaf of its document's source through its node."""
    leaves = materialize(site_wordings(parsed).select("source", "above", "node"))
    letters = F.transform(F.split("text", "\n"), lambda l: _letters(_words(l)))
    lines = (
        pages.select("doc_id", "page_no", F.posexplode(letters).alias("line_no", "letters"))
        .filter(F.length("letters") >= MIN_LETTERS)
        .select("doc_id", "page_no", "line_no", _letter_node(F.col("letters")).alias("above"), _leaf(F.col("letters")).alias("node"))
    )
    # first by path alone, which few lines pass; only those go through the join for their source
    candidates = lines.join(join_side(leaves.select("above", "node").distinct()), ["above", "node"], "left_semi")
    sources = parsed.filter(~F.col("scanned")).select("doc_id", _source(F.col("source")).alias("source"))
    placed = candidates.join(sources, "doc_id")
    return placed.join(join_side(leaves), ["source", "above", "node"], "left_semi").select("doc_id", F.col("page_no").cast("int"), F.col("line_no").cast("int"))


def site_templates(parsed: DataFrame) -> DataFrame:
    """``source, node, template, documents, wordings, fixed``: the covering nodes of the word trees, with ``<*>`` for words that differ."""
    docs = _plain_documents(parsed)
    lines = docs.select("source", F.filter(F.transform(F.split("text", "\n"), _words), _long_enough).alias("lines"))
    nodes = lines.select("source", F.explode(F.array_distinct(F.flatten(F.transform("lines", _word_nodes)))).alias("node"))
    side = join_side(_covering(nodes, _sizes(docs)))
    words = (
        lines.select("source", F.explode("lines").alias("words"))
        .select("source", "words", F.explode(_word_nodes(F.col("words"))).alias("node"))
        .join(side, ["source", "node"])
        .groupBy("source", "node", "words")
        .agg(F.max("documents").alias("documents"))
    )
    slots = (
        words.select("source", "node", "documents", F.posexplode(F.split("words", " ")).alias("slot", "word"))
        .groupBy("source", "node", "slot")
        .agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max("documents").alias("documents"), F.count("*").alias("wordings"))
    )
    fixed = F.col("low") == F.col("high")
    word = F.when(fixed, F.col("low")).otherwise(F.lit("<*>"))
    # a node's lines have one number of words, so every slot is met by every wording
    return slots.groupBy("source", "node").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", word.alias("word")))), lambda s: s["word"]), " ").alias("template"),
        F.max("documents").alias("documents"), F.max("wordings").alias("wordings"), F.avg(fixed.cast("double")).alias("fixed"),
    )


def without_site_lines(parsed: DataFrame, templates: bool = False) -> DataFrame:
    """``doc_id, text, removed, by_template``: the texts of the non-scanned documents without the lines that :func:`found_lines`
    finds; with ``templates`` also without those that only a wildcard template with enough fixed words covers, ``by_template`` of them.

    Each source's marks (few: each stands in a tenth of its documents) meet its documents as two arrays."""
    leaves = site_wordings(parsed).select("source", F.lit("l").alias("kind"), "node")
    if templates:
        leaves = leaves.unionByName(site_templates(parsed).filter(F.col("fixed") >= MIN_FIXED).select("source", F.lit("n").alias("kind"), "node"))
    leaves = materialize(leaves)
    gathered = leaves.groupBy("source").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "l", F.col("node")))).alias("leaves"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "n", F.col("node")))).alias("nodes"),
    )
    docs = _plain_documents(parsed)
    if leaves.count() <= 200_000:
        joined = docs.join(F.broadcast(gathered), "source", "left")
    else:  # the same join by shuffle; a source's documents are dealt over SALTS tasks
        salted = gathered.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "salt"], "left")
    empty = F.array().cast("array<bigint>")

    def mark(line):
        words = _words(line)
        exact = _long_enough(words) & F.array_contains(F.coalesce("leaves", empty), _leaf(_letters(words)))
        kin = F.lit(False) if not templates else _long_enough(words) & F.arrays_overlap(F.coalesce("nodes", empty), _word_nodes(words))
        return F.struct(line.alias("line"), F.when(exact, 2).when(kin, 1).otherwise(0).alias("mark"))

    marked = joined.select("doc_id", F.transform(F.split("text", "\n"), mark).alias("lines"))
    text = F.array_join(F.transform(F.filter("lines", lambda l: l["mark"] == 0), lambda l: l["line"]), "\n")
    many = lambda n: F.size(F.filter("lines", lambda l: l["mark"] == n))
    return marked.select("doc_id", text.alias("text"), (many(2) + many(1)).alias("removed"), many(1).alias("by_template"))
