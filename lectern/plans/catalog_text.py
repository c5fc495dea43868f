"""Registered queries of the operators on texts, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.cluster import approx_tokens
from ..operators import chunking, cleaning, context, retrieval, structure
from ..streaming import jobs
from .catalog import _asks, hybrid_lists, query, sound_vectors, table, tokens_sql, units_sql

_SP = r"[ \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+"


def _replace(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, '{pattern}', {by}, 'g')"


def _clean_sql() -> str:
    c = _replace("text", r"\r\n?", "chr(10)")
    c = _replace(c, r"^\n+|\n+$", "''")
    c = _replace(c, r"\n{3,}", "chr(10) || chr(10)")
    c = f"replace({c}, chr(173) || chr(10), '-' || chr(10))"
    c = _replace(c, r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "''")
    c = _replace(c, r"[\x{2010}\x{2011}]", "'-'")
    c = _replace(c, _SP + r"\n", "chr(10)")
    c = _replace(c, _SP + "$", "''")
    return _replace(c, _SP, "' '")


@query(f"SELECT doc_id, page_no, {_clean_sql()} AS text FROM pages")
def clean_unicode(spark, d):
    return cleaning.unicode_cleaner(table(spark, d, "pages")).select("doc_id", "page_no", "text")


_EDGES = """
    cut AS (SELECT doc_id, page_no, page_index, string_split(text, chr(10)) AS ls FROM pages),
    lines AS (SELECT doc_id, page_no, page_index, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM cut),
    solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no DESC) AS down
              FROM lines WHERE regexp_matches(line, '\\S')),
    edges AS (SELECT * FROM solid WHERE up <= 3 OR down <= 3)"""


@query(f"""WITH {_EDGES},
    keyed AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM edges),
    sizes AS (SELECT doc_id, count(*) AS n, count(*) FILTER (page_index % 2 = 0) AS n0, count(*) FILTER (page_index % 2 = 1) AS n1 FROM pages WHERE regexp_matches(text, '\\S') GROUP BY 1 HAVING count(*) >= 3),
    seen AS (SELECT doc_id, key, count(*) AS c, count(*) FILTER (page_index % 2 = 0) AS c0, count(*) FILTER (page_index % 2 = 1) AS c1 FROM (SELECT DISTINCT doc_id, key, page_index FROM keyed WHERE key <> '') GROUP BY 1, 2),
    keys AS (SELECT doc_id, key FROM seen JOIN sizes USING (doc_id) WHERE c > n / 2.0 OR (n0 >= 3 AND c0 > n0 / 2.0) OR (n1 >= 3 AND c1 > n1 / 2.0))
    SELECT doc_id, page_no, cast(line_no AS INTEGER) AS line_no, key FROM keyed JOIN keys USING (doc_id, key)""")
def header_footer_lines(spark, d):
    return cleaning.running_lines(table(spark, d, "pages")).select("doc_id", "page_no", F.col("line_no").cast("int"), "key")


@query()
def page_number_lines(spark, d):
    return cleaning.page_number_lines(table(spark, d, "pages"))


@query("SELECT doc_id, page_no, regexp_replace(text, '(\\pL\\pL)[-\\x{2010}\\x{2011}][ \\t]*\\n(\\p{Ll})', '\\1\\2', 'g') AS text FROM pages")
def clean_dehyphenate(spark, d):
    return cleaning.dehyphenate_cleaner(table(spark, d, "pages")).select("doc_id", "page_no", "text")


@query()
def clean_pages(spark, d):
    """All cleaners in their configured order."""
    return cleaning.clean(table(spark, d, "pages"), ["unicode", "page-numbers", "headers-footers", "dehyphenate"]).select("doc_id", "page_no", "text")


@query(f"""WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM parsed_documents), l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM lines),
    n AS (SELECT *, regexp_extract(line, '^(\\d+(?:\\.\\d+)*) \\S.*[^.!?]$', 1) AS number FROM l)
    SELECT doc_id, cast(line_no AS INTEGER) AS line_no, number, cast(len(string_split(number, '.')) AS INTEGER) AS level, substr(line, length(number) + 2) AS title FROM n WHERE number <> ''""")
def numbered_headings(spark, d):
    return structure.numbered_headings(table(spark, d, "parsed_documents"))


@query(f"""WITH n AS (SELECT doc_id, text, {units_sql('text')} AS u, ceil({units_sql('text')} / 4.0)::BIGINT AS n FROM documents),
    w AS (SELECT doc_id, text, u, unnest(range(greatest(ceil((n - 400) / 340.0), 0)::BIGINT + 1)) AS w FROM n WHERE n > 0),
    c AS (SELECT doc_id, w, text, length(text) < u AS wide, w * 1360 AS a, least(w * 1360 + 1600, u) AS b FROM w),
    -- in texts with characters of two units: the units up to and with each character
    k AS (SELECT doc_id, list_transform(range(1, length(text) + 1), lambda i: length(text[1:i]) + length(regexp_replace(text[1:i], '[^\\x{{10000}}-\\x{{10FFFF}}]+', '', 'g'))) AS ends FROM n WHERE length(text) < u),
    s AS (SELECT c.doc_id, w, wide, a, b, text, CASE WHEN wide THEN len(list_filter(ends, lambda e: e <= a)) ELSE a END AS p, CASE WHEN wide THEN len(list_filter(ends, lambda e: e <= b)) ELSE b END AS q,
                 ends FROM c LEFT JOIN k USING (doc_id))
    SELECT doc_id, cast(w AS INTEGER) AS chunk_no, cast(CASE WHEN NOT wide THEN a WHEN p = 0 THEN 0 ELSE ends[p] END AS INTEGER) AS char_start, cast(CASE WHEN wide THEN ends[q] ELSE b END AS INTEGER) AS char_end,
           substr(text, p + 1, q - p) AS text FROM s WHERE regexp_matches(substr(text, p + 1, q - p), '\\S')""")
def fixed_size_chunks(spark, d):
    rows = chunking.fixed_size(table(spark, d, "documents"))
    return rows.select("doc_id", "chunk_no", F.col("char_start").cast("int"), F.col("char_end").cast("int"), "text")


@query()
def recursive_chunks(spark, d):
    return chunking.recursive(table(spark, d, "documents"))


@query()
def structure_aware_chunks(spark, d):
    return chunking.structure_aware(table(spark, d, "parsed_documents"))


@query()
def semantic_chunks(spark, d):
    return chunking.semantic(table(spark, d, "documents"))


@query()
def parent_child_chunks(spark, d):
    return chunking.parent_child(table(spark, d, "documents"))


@query(f"WITH t AS (SELECT strategy, {tokens_sql('text')} AS n FROM chunks) SELECT strategy, count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median FROM t GROUP BY 1")
def chunk_stats(spark, d):
    return chunking.sizes(table(spark, d, "chunks")).withColumn("mean", F.round("mean", 6))


@query(f"""WITH t AS (SELECT {tokens_sql('text')} AS n FROM chunks), e AS (SELECT min(n) AS lo, max(n) AS hi, greatest(1, ceil((max(n) - min(n) + 1) / 8.0))::BIGINT AS width FROM t),
    b AS (SELECT lo, hi, width, unnest(range(ceil((hi - lo + 1) / cast(width AS DOUBLE))::BIGINT)) AS b FROM e),
    c AS (SELECT floor((n - lo) / cast(width AS DOUBLE))::BIGINT AS b, count(*) AS chunks FROM t, e GROUP BY 1)
    SELECT lo + b * width AS from_tokens, least(lo + (b + 1) * width, hi + 1) AS to_tokens, coalesce(chunks, 0) AS chunks FROM b LEFT JOIN c USING (b)""")
def chunk_histogram(spark, d):
    return chunking.histogram(table(spark, d, "chunks"))


@query("""SELECT c.chunk_id, min(p.page_no) AS first_page, max(p.page_no) AS last_page FROM (SELECT DISTINCT chunk_id, doc_id, char_start, char_end FROM chunks) c
    JOIN pages p ON p.doc_id = c.doc_id AND p.char_end > c.char_start AND p.char_start < c.char_end GROUP BY 1""")
def chunk_page_ranges(spark, d):
    return chunking.page_ranges(table(spark, d, "chunks"), table(spark, d, "pages"))


@query("SELECT chunk_id, 'duplicate-id' AS problem FROM chunks GROUP BY 1 HAVING count(*) > 1")
def chunk_violations(spark, d):
    return chunking.violations(table(spark, d, "chunks"), table(spark, d, "parsed_documents"))


@query("SELECT chunk_id, CASE WHEN array_to_string(section_path, ' > ') = '' THEN text ELSE array_to_string(section_path, ' > ') || chr(10) || chr(10) || text END AS embed_text FROM chunks")
def context_texts(spark, d):
    return chunking.with_context(table(spark, d, "chunks")).select("chunk_id", "embed_text")


def _candidates(spark, d):
    hits = retrieval.rrf(hybrid_lists(spark, d), 20)
    one = table(spark, d, "chunks").select("chunk_id", "text", "section_path", "page_start", "page_end", "doc_id").dropDuplicates(["chunk_id"])
    return hits.join(one, "chunk_id")


@query()
def assembled_context(spark, d):
    return context.assemble(_candidates(spark, d))


@query()
def prompts(spark, d):
    return context.prompts(context.assemble(_candidates(spark, d)), table(spark, d, "chunks"))


@query()
def diversified(spark, d):
    hits = retrieval.rrf(hybrid_lists(spark, d), 50).join(sound_vectors(spark, d), "chunk_id")
    return context.diversify(hits, 5)


@query("SELECT doc_id, page_no, cast(CASE WHEN page_no % 2 = 1 THEN (page_no + 1) / 2 ELSE n - page_no / 2 + 1 END AS INTEGER) AS place FROM pages JOIN (SELECT doc_id, count(*) AS n FROM pages GROUP BY 1) USING (doc_id)")
def sandwich_order(spark, d):
    pages = table(spark, d, "pages")
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    return pages.join(total, "doc_id").select("doc_id", "page_no", context.sandwich_place(F.col("page_no"), F.col("n")).alias("place"))


@query(f"""WITH a AS (SELECT answer_id, line_no, given, len(sources) AS n, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(given, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: list_transform(string_split(m, ','), lambda x: cast(trim(x) AS BIGINT)))))) AS cited FROM review_items WHERE given IS NOT NULL)
    SELECT line_no, CASE WHEN n = 0 THEN 'no-sources' END AS decision, cast(len(list_filter(cited, lambda x: x < 1 OR x > n)) AS INTEGER) AS unknown FROM a""")
def grounding(spark, d):
    answers = table(spark, d, "review_items").filter("given IS NOT NULL").select("line_no", F.col("given").alias("text"), F.size("sources").alias("sources"), F.lit(1.0).alias("best_score"))
    return context.ground(answers).select("line_no", "decision", F.size("unknown_citations").alias("unknown"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    stream = jobs.windowed(jobs.read_log(spark, f"{d}/events.parquet"), "1 hour")
    return jobs.run_to_end(stream, "update", ["start", "event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT answer_id, arg_max(rating, line_no) AS rating, max(line_no) AS line_no FROM review_items GROUP BY answer_id")
def stream_latest_ratings(spark, d):
    return jobs.run_to_end(jobs.latest_ratings(jobs.read_log(spark, f"{d}/review_items.parquet")), "update", ["answer_id"])


@query()
def stream_sessions(spark, d):
    """Sessions that have ended by the watermark."""
    return jobs.run_to_end(jobs.sessions(jobs.read_log(spark, f"{d}/events.parquet"), "30 minutes"), "append", ["user_id", "start"])


@query("SELECT vec_id, round(list_distance(cast(embedding AS DOUBLE[]), (SELECT cast(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings")
def distances_from_first(spark, d):
    one = F.broadcast(_asks(spark, d).filter("qid = 0"))  # one row
    return table(spark, d, "embeddings").join(one, F.lit(True)).select("vec_id", F.round(V.euclidean(F.col("embedding"), F.col("qv")), 6).alias("distance"))


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def document_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"))
