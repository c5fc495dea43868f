"""Registered queries of the engine's own operators, each over its whole tables, with the SQL that states its result.

Searches take a stated query set against all rows: the labelled questions, or every vector whose id is divisible by 50.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, ids
from ..functions import text as X
from ..functions import vectors as V
from ..functions.cluster import approx_tokens, materialize, utf16_units
from ..operators import accounting, evaluation, retrieval

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_sql(c: str) -> str:
    return f"(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]+', '', 'g')))"


def tokens_sql(c: str) -> str:
    return f"cast(ceil({units_sql(c)} / 4.0) AS BIGINT)"


def _plain_forms() -> tuple[str, str]:
    """Letters and digits that have a compatibility form of one character, and those forms."""
    ranges = (range(0x80, 0x3000), range(0xFF00, 0xFFF0), range(0x1D400, 0x1D800))
    pairs = [(chr(p), n) for r in ranges for p in r if (n := unicodedata.normalize("NFKC", chr(p))) != chr(p) and len(n) == 1 and n.isalnum()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_COMPATIBLE = _plain_forms()


def terms_sql(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower(translate({c}, '{_COMPATIBLE[0]}', '{_COMPATIBLE[1]}')), '[''’]', '', 'g'), '[\\pL\\pN]+')"


# --- scalars


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents) GROUP BY ALL")
def analyze_terms(spark, d):
    docs = X.with_compatible(table(spark, d, "documents"), "text").select("doc_id", F.explode(X.terms(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"SELECT answer_id, list_sort(list_distinct(flatten(list_transform(regexp_extract_all(given, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: list_transform(string_split(m, ','), lambda n: cast(trim(n) AS BIGINT)))))) AS cited FROM review_items WHERE given IS NOT NULL")
def cited_numbers(spark, d):
    return table(spark, d, "review_items").filter("given IS NOT NULL").select("answer_id", X.cited_numbers(F.col("given")).alias("cited"))


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_FLAT}) > 90 THEN substr({_FLAT}, 1, 89) || '…' ELSE {_FLAT} END AS snippet FROM documents")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), 90).alias("snippet"))


_SPLIT = "regexp_replace(regexp_replace(text, '([.!?][\"'')\\]]*)\\s+([\"''(\\[]?[\\p{Lu}\\pN])', '\\1' || chr(1) || '\\2', 'g'), '\\n{2,}', chr(1), 'g')"


@query(f"WITH s AS (SELECT doc_id, unnest(string_split({_SPLIT}, chr(1))) AS sentence FROM documents), t AS (SELECT doc_id, regexp_replace(regexp_replace(sentence, '^\\s+', ''), '\\s+$', '') AS sentence FROM s) SELECT doc_id, count(*) AS sentences, cast(sum(length(sentence)) AS BIGINT) AS chars FROM t WHERE sentence <> '' GROUP BY doc_id")
def sentence_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"))


_SHINGLES = "list_distinct(list_transform(range(0, greatest(len({0}) - 3, 0) + 1), lambda i: array_to_string({0}[i + 1 : i + 3], ' ')))"


@query(f"""
    WITH t AS (SELECT answer_id, line_no, {terms_sql('question')} AS a, {terms_sql('given')} AS b FROM review_items WHERE given IS NOT NULL),
    s AS (SELECT line_no, {_SHINGLES.format('a')} AS a, {_SHINGLES.format('b')} AS b FROM t)
    SELECT line_no, round(len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS similarity FROM s""")
def echo_similarity(spark, d):
    rows = table(spark, d, "review_items").filter("given IS NOT NULL").select("line_no", X.shingles(F.col("question")).alias("a"), X.shingles(F.col("given")).alias("b"))
    return rows.select("line_no", F.round(X.jaccard("a", "b"), 6).alias("similarity"))


@query("""
    SELECT chunk_id, '[1] ' || CASE WHEN array_to_string(section_path, ' > ') = '' THEN '' ELSE array_to_string(section_path, ' > ') || ' ' END || '(' ||
      CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END || ')' || chr(10) ||
      regexp_replace(text, '<(/?)(sources)>', '&lt;\\1\\2>', 'gi') AS block FROM chunks""")
def source_blocks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", X.source_block(F.lit(1), F.col("section_path"), F.col("page_start"), F.col("page_end"), F.col("text")).alias("block"))


@query("SELECT chunk_id, sha256('5:chunk|' || length(doc_id) || ':' || doc_id || '|' || length(strategy) || ':' || strategy || '|' || length(char_start::VARCHAR) || ':' || char_start || '|' || length(char_end::VARCHAR) || ':' || char_end || '|' || length(text) || ':' || text || '|') AS computed FROM chunks")
def chunk_ids(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", ids.chunk_id(F.col("doc_id"), F.col("strategy"), F.col("char_start"), F.col("char_end"), F.col("text")).alias("computed"))


@query("SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    copies = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return copies.filter("copies > 1")


@query()
def document_ids(spark, d):
    return table(spark, d, "parsed_documents").select("sha256", ids.document_id(F.col("sha256")).alias("document_id"))


# --- filters


@query("SELECT chunk_id FROM chunks WHERE page_end >= 2 AND page_start <= 4 AND strategy IN ('recursive', 'fixed-size')")
def filter_pages_and_strategies(spark, d):
    keep = filters.all_of(filters.page_range(2, 4), filters.any_of("strategy", ["recursive", "fixed-size"]))
    return table(spark, d, "chunks").filter(keep).select("chunk_id")


@query("WITH first AS (SELECT min(section_path[1]) AS title FROM chunks) SELECT chunk_id FROM chunks, first WHERE lower(trim(section_path[1])) = lower(trim(title))")
def filter_section(spark, d):
    chunks = table(spark, d, "chunks")
    title = chunks.agg(F.min(F.get("section_path", F.lit(0))).alias("t")).first()["t"]
    return chunks.filter(filters.section([f"  {title.upper()} "])).select("chunk_id")


# --- keyword search

_INDEXED = """
    kept AS (SELECT chunk_id, min(coalesce(embed_text, text)) AS t FROM chunks WHERE indexed GROUP BY chunk_id),
    words AS (SELECT chunk_id, unnest(""" + terms_sql("t") + """) AS term FROM kept),
    post AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
    lens AS (SELECT k.chunk_id, coalesce(sum(p.tf), 0) AS len FROM kept k LEFT JOIN post p USING (chunk_id) GROUP BY 1),
    corpus AS (SELECT count(*) AS n, avg(len) AS a FROM lens),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""


def _bm25_sql(name: str, text: str, keep: str = "true", source: str = "questions") -> str:
    return f"""
    {name}_q AS (SELECT DISTINCT qid, unnest({terms_sql(text)}) AS term FROM {source}),
    {name}_s AS (
      SELECT q.qid, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score
      FROM {name}_q q JOIN post p USING (term) JOIN freq USING (term) JOIN lens USING (chunk_id), corpus
      WHERE p.chunk_id IN (SELECT chunk_id FROM chunks WHERE {keep}) GROUP BY 1, 2),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {name}_s)"""


def _indexed(spark, d):
    return table(spark, d, "chunks").filter("indexed")


@query(f"WITH {_INDEXED} SELECT term, df, cast((SELECT sum(tf) FROM post p WHERE p.term = freq.term) AS BIGINT) AS occurrences FROM freq")
def term_frequencies(spark, d):
    return retrieval.postings(_indexed(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query(f"WITH {_INDEXED} SELECT chunk_id, cast(len AS BIGINT) AS len FROM lens")
def chunk_lengths(spark, d):
    chunks = _indexed(spark, d)
    return retrieval.chunk_lengths(chunks, retrieval.postings(chunks))


@query(f"WITH {_INDEXED}, {_bm25_sql('bm', 'question')} SELECT qid, chunk_id, score, rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    return retrieval.bm25_search(_indexed(spark, d), table(spark, d, "questions"), 5).drop("retriever").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_INDEXED}, {_bm25_sql('bm', 'question', 'page_end >= 2 AND page_start <= 3')} SELECT qid, chunk_id, score, rank FROM bm WHERE rank <= 5")
def bm25_topk_filtered(spark, d):
    hits = retrieval.bm25_search(_indexed(spark, d), table(spark, d, "questions"), 5, filters.page_range(2, 3))
    return hits.drop("retriever").withColumn("rank", F.col("rank").cast("bigint"))


# --- dense search

_COS = "list_cosine_similarity(cast(a.embedding AS DOUBLE[]), cast(b.embedding AS DOUBLE[]))"


def _dense_sql(score: str, keep: str = "true") -> str:
    return f"""
    WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round({score}, 6) + 0.0 AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {keep}),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT qid, vec_id, score, rank FROM r WHERE rank <= 10"""


def _asks(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _dense(spark, d, **options):
    hits = retrieval.dense_search(table(spark, d, "embeddings"), _asks(spark, d), 10, id_col="vec_id", vector_col="embedding", **options)
    return hits.select("qid", F.col("chunk_id").alias("vec_id"), "score", F.col("rank").cast("bigint").alias("rank"))


@query(_dense_sql(_COS))
def dense_topk(spark, d):
    return _dense(spark, d)


@query(_dense_sql(_COS, "b.label = 3"))
def dense_topk_filtered(spark, d):
    return _dense(spark, d, keep=F.col("label") == 3)


@query(_dense_sql("-list_distance(cast(a.embedding AS DOUBLE[]), cast(b.embedding AS DOUBLE[]))"))
def euclidean_topk(spark, d):
    return _dense(spark, d, measure="euclidean")


def _ann(spark, d):
    """Random vectors without clusters: most lists must be probed."""
    return retrieval.cluster_search(table(spark, d, "embeddings"), _asks(spark, d), 10, "vec_id", "embedding", list_rows=250, share=0.8)


@query()
def ann_topk(spark, d):
    return _ann(spark, d).select("qid", F.col("chunk_id").alias("vec_id"), "score", F.col("rank").cast("bigint").alias("rank"))


def _chunk_asks(vectors):
    """Every chunk whose id, as a number, is divisible by 50."""
    return vectors.filter(F.conv(F.right("chunk_id", F.lit(8)), 16, 10).cast("bigint") % 50 == 0).select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qv"))


def _ann_chunks(spark, d):
    vectors = sound_vectors(spark, d)
    return retrieval.cluster_search(vectors, _chunk_asks(vectors), 10, "chunk_id", "vector", list_rows=500, share=0.15)


@query()
def ann_chunks(spark, d):
    return _ann_chunks(spark, d).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT * FROM (VALUES ('embeddings', true), ('vectors', true)) v(searched, enough)")
def ann_recall(spark, d):
    """Recall of both approximate searches against the exact ones: at least 0.9."""
    vectors = sound_vectors(spark, d)
    pairs = {
        "embeddings": (_ann(spark, d), retrieval.dense_search(table(spark, d, "embeddings"), _asks(spark, d), 10, id_col="vec_id", vector_col="embedding").withColumnRenamed("vec_id", "chunk_id")),
        "vectors": (_ann_chunks(spark, d), retrieval.dense_search(vectors, _chunk_asks(vectors), 10)),
    }
    rows = []
    for name, (near, exact) in pairs.items():
        least = exact.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        # a hit as near as the tenth exact one counts, whatever its id
        found = near.withColumnRenamed("vec_id", "chunk_id").join(least, "qid", "right").groupBy("qid").agg(F.count_if(F.col("score") >= F.col("least")).alias("hit"), F.max("n").alias("n"))
        rows.append(found.agg((F.sum("hit") >= 0.9 * F.sum("n")).alias("enough")).select(F.lit(name).alias("searched"), "enough"))
    return rows[0].unionByName(rows[1])


@query("SELECT vec_id, round(sqrt(list_inner_product(cast(embedding AS DOUBLE[]), cast(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


# --- hybrid search: the dense list of a question starts from the vector of its best keyword hit

_SOUND = """
    sound AS (SELECT chunk_id, min(vector) AS v FROM vectors WHERE vector IS NOT NULL AND len(vector) = 64
      AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY chunk_id)"""
_HYBRID = f"""
    WITH {_INDEXED}, {_bm25_sql('bm', 'question')}, {_SOUND},
    seed AS (SELECT qid, v FROM bm JOIN sound USING (chunk_id) WHERE rank = 1),
    de_s AS (SELECT qid, s.chunk_id, round(list_cosine_similarity(cast(seed.v AS DOUBLE[]), cast(s.v AS DOUBLE[])), 6) AS score FROM seed, sound s),
    de AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM de_s),
    lists AS (SELECT qid, chunk_id, score, rank, 'bm25' AS retriever FROM bm WHERE rank <= 50 UNION ALL SELECT qid, chunk_id, score, rank, 'dense' FROM de WHERE rank <= 50)"""
_RRF = f"""{_HYBRID},
    rrf_s AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM lists GROUP BY 1, 2),
    rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM rrf_s)"""


def sound_vectors(spark, d):
    """One usable vector of each chunk."""
    v = F.col("vector")
    ok = v.isNotNull() & (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return table(spark, d, "vectors").filter(ok).groupBy("chunk_id").agg(F.min("vector").alias("vector"))


def hybrid_lists(spark, d) -> DataFrame:
    bm = materialize(retrieval.bm25_search(_indexed(spark, d), table(spark, d, "questions"), retrieval.HYBRID_DEPTH))
    vectors = sound_vectors(spark, d)
    seeds = bm.filter("rank = 1").select("qid", "chunk_id").join(vectors, "chunk_id").select("qid", F.col("vector").alias("qv"))
    return materialize(bm.unionByName(retrieval.dense_search(vectors, seeds, retrieval.HYBRID_DEPTH)))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"{_RRF} SELECT qid, chunk_id, score, rank FROM rrf WHERE rank <= 5")
def hybrid_topk(spark, d):
    return _ranked(retrieval.rrf(hybrid_lists(spark, d), 5))


@query(f"""{_HYBRID},
    edges AS (SELECT qid, retriever, min(score) AS lo, max(score) AS hi FROM lists GROUP BY 1, 2),
    w AS (SELECT qid, retriever, CASE retriever WHEN 'bm25' THEN 0.3 ELSE 0.7 END AS w FROM edges),
    tot AS (SELECT qid, sum(w) AS a FROM w GROUP BY 1),
    sc AS (SELECT l.qid, l.chunk_id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END * w.w) / max(a), 6) AS score
           FROM lists l JOIN edges e ON l.qid = e.qid AND l.retriever = e.retriever JOIN w ON w.qid = l.qid AND w.retriever = l.retriever JOIN tot ON tot.qid = l.qid GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc)
    SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 5""")
def weighted_topk(spark, d):
    return _ranked(retrieval.weighted_fusion(hybrid_lists(spark, d), {"bm25": 0.3, "dense": 0.7}, 5))


_PARENT = "(SELECT DISTINCT chunk_id, coalesce(parent_id, chunk_id) AS parent FROM chunks)"


@query(f"""{_RRF},
    best AS (SELECT qid, parent, min(rank) AS rank FROM rrf JOIN {_PARENT} USING (chunk_id) WHERE rank <= 20 GROUP BY 1, 2),
    r AS (SELECT b.qid, b.parent AS chunk_id, rrf.score, row_number() OVER (PARTITION BY b.qid ORDER BY b.rank, b.parent) AS rank FROM best b JOIN rrf ON rrf.qid = b.qid AND rrf.rank = b.rank)
    SELECT * FROM r WHERE rank <= 5""")
def parent_expansion(spark, d):
    return _ranked(retrieval.expand_parents(retrieval.rrf(hybrid_lists(spark, d), 20), table(spark, d, "chunks"), 5))


@query(f"""WITH {_INDEXED}, {_bm25_sql('bm', 'question')}, {_bm25_sql('hy', 'answer')},
    lists AS (SELECT qid, chunk_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT qid, chunk_id, rank FROM hy WHERE rank <= 20),
    paired AS (SELECT qid FROM questions WHERE answer IS NOT NULL AND EXISTS (SELECT 1 FROM hy WHERE hy.qid = questions.qid) AND EXISTS (SELECT 1 FROM bm WHERE bm.qid = questions.qid)),
    s AS (SELECT qid, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM lists WHERE qid IN (FROM paired) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s UNION ALL
          SELECT qid, chunk_id, score, rank FROM bm WHERE qid NOT IN (FROM paired) UNION ALL SELECT qid, chunk_id, score, rank FROM hy WHERE qid NOT IN (FROM paired))
    SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 5""")
def multi_query_topk(spark, d):
    """The question and its hypothetical answer as two variants."""
    asked = table(spark, d, "questions")
    both = asked.select(F.struct("qid", F.lit(0).alias("variant")).alias("qid"), "question").unionByName(
        asked.filter("answer IS NOT NULL").select(F.struct("qid", F.lit(1).alias("variant")).alias("qid"), F.col("answer").alias("question"))
    )
    hits = retrieval.bm25_search(_indexed(spark, d), both, retrieval.MULTI_QUERY_DEPTH)
    return _ranked(retrieval.multi_query(hits.select("qid.qid", "qid.variant", "chunk_id", "score", "rank"), 5))


@query(f"""{_RRF},
    cut AS (SELECT qid, chunk_id, score, rank FROM rrf WHERE rank <= 20),
    s AS (SELECT c.*, t.n AS tokens FROM cut c JOIN (SELECT DISTINCT chunk_id, {tokens_sql('text')} AS n FROM chunks) t USING (chunk_id)),
    r AS (SELECT qid, chunk_id, cast(-tokens AS DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY tokens, rank) AS rank FROM s)
    SELECT qid, chunk_id, score, rank FROM r WHERE rank <= 5""")
def reranked_topk(spark, d):
    """Twenty candidates put in order by a scorer that likes short passages."""
    hits = retrieval.rrf(hybrid_lists(spark, d), 20)
    sizes = table(spark, d, "chunks").select("chunk_id", (-approx_tokens(F.col("text"))).cast("double").alias("new_score")).distinct()
    scores = hits.select("qid", "chunk_id").join(sizes, "chunk_id")
    return _ranked(retrieval.rerank(hits, scores, 5))


# --- evaluation: each method's list judged against the spans of the three best dense hits

_SPANS = "(SELECT DISTINCT chunk_id, doc_id, char_start AS s, char_end AS e FROM chunks)"
_JUDGED = f"""{_RRF},
    gold AS (SELECT qid, rank AS gold_ix, doc_id, s, e FROM de JOIN {_SPANS} USING (chunk_id) WHERE rank <= 3 AND e > s),
    variants AS (SELECT 'bm25' AS variant, qid, chunk_id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'rrf', qid, chunk_id, rank FROM rrf WHERE rank <= 10),
    hits AS (SELECT variant, qid, rank, doc_id, s, e FROM variants JOIN {_SPANS} USING (chunk_id)),
    met AS (SELECT h.variant, h.qid, h.rank, g.gold_ix FROM hits h JOIN gold g ON h.qid = g.qid AND h.doc_id = g.doc_id AND h.s < g.e AND g.s < h.e WHERE h.e > h.s),
    firsts AS (SELECT DISTINCT variant, qid, rank FROM (SELECT variant, qid, gold_ix, min(rank) AS rank FROM met GROUP BY 1, 2, 3)),
    judged AS (SELECT h.variant, h.qid, h.rank, EXISTS (SELECT 1 FROM met m WHERE m.variant = h.variant AND m.qid = h.qid AND m.rank = h.rank) AS relevant,
                      EXISTS (SELECT 1 FROM firsts f WHERE f.variant = h.variant AND f.qid = h.qid AND f.rank = h.rank) AS newly_covered FROM hits h),
    golds AS (SELECT qid, count(*) AS golds FROM gold GROUP BY 1),
    metrics AS (
      SELECT v.variant, g.qid, cast(coalesce(max(relevant::INT), 0) AS DOUBLE) AS hit, coalesce(sum(relevant::INT), 0) / 10.0 AS precision,
             least(1.0, coalesce(sum(newly_covered::INT), 0) / cast(max(golds) AS DOUBLE)) AS recall, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS mrr,
             coalesce(sum(CASE WHEN newly_covered THEN 1 / log2(rank + 1) ELSE 0 END), 0) / list_sum(list_transform(range(1, cast(least(max(golds), 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
      FROM golds g CROSS JOIN (VALUES ('bm25'), ('rrf')) v(variant) LEFT JOIN judged j ON j.qid = g.qid AND j.variant = v.variant GROUP BY 1, 2)"""


def _judged(spark, d):
    lists = hybrid_lists(spark, d)
    spans = table(spark, d, "chunks").select("chunk_id", "doc_id", F.col("char_start").alias("start"), F.col("char_end").alias("end")).distinct()
    dense = lists.filter("retriever = 'dense' AND rank <= 3").join(spans, "chunk_id")
    gold = materialize(dense.select("qid", F.col("rank").alias("gold_ix"), "doc_id", "start", "end").filter(F.col("end") > F.col("start")))
    lists_of = {"bm25": lists.filter("retriever = 'bm25' AND rank <= 10"), "rrf": retrieval.rrf(lists, 10)}
    judged = {v: evaluation.judge(h.join(spans, "chunk_id").select("qid", "rank", "doc_id", "start", "end"), gold) for v, h in lists_of.items()}
    return judged, gold.groupBy("qid").agg(F.count("*").alias("golds"))


def _metrics(spark, d):
    judged, golds = _judged(spark, d)
    parts = [evaluation.retrieval_metrics(j, golds, 10).withColumn("variant", F.lit(v)) for v, j in judged.items()]
    return parts[0].unionByName(parts[1])


@query(f"{_JUDGED} SELECT qid, rank, relevant, newly_covered FROM judged WHERE variant = 'rrf'")
def judged_hits(spark, d):
    return _judged(spark, d)[0]["rrf"].select("qid", F.col("rank").cast("bigint").alias("rank"), "relevant", "newly_covered")


_FIVE = ("hit", "precision", "recall", "mrr", "ndcg")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _FIVE)


@query(f"{_JUDGED} SELECT variant, qid, {_ROUNDED} FROM metrics")
def metrics_at_k(spark, d):
    return _metrics(spark, d).select("variant", "qid", *[F.round(c, 6).alias(c) for c in _FIVE])


@query(f"{_JUDGED} SELECT variant, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _FIVE)}, count(*) AS questions FROM metrics GROUP BY 1")
def macro_means(spark, d):
    return _metrics(spark, d).groupBy("variant").agg(*[F.round(F.avg(c), 6).alias(c) for c in _FIVE], F.count("*").alias("questions"))


@query(f"""{_JUDGED}, diff AS (SELECT b.ndcg - a.ndcg AS x FROM metrics a JOIN metrics b ON a.qid = b.qid WHERE a.variant = 'bm25' AND b.variant = 'rrf')
    SELECT 'rrf' AS variant, count(*) FILTER (x > 1e-9) AS wins, count(*) FILTER (x < -1e-9) AS losses, count(*) FILTER (abs(x) <= 1e-9) AS ties, round(avg(x), 6) AS mean_difference FROM diff""")
def ab_compare(spark, d):
    return evaluation.compare(_metrics(spark, d), "bm25", "ndcg").withColumn("mean_difference", F.round("mean_difference", 6))


@query()
def ab_intervals(spark, d):
    return evaluation.bootstrap_intervals(_metrics(spark, d), "bm25", "ndcg")


@query(f"""{_JUDGED}, m AS (SELECT a.recall AS before, b.recall AS after FROM metrics a JOIN metrics b ON a.qid = b.qid WHERE a.variant = 'bm25' AND b.variant = 'rrf')
    SELECT cast(0 AS BIGINT) AS missing, cast(0 AS BIGINT) AS extra, count(*) FILTER (after < before - 1e-9) AS worse, count(*) FILTER (after > before + 1e-9) AS better,
           round(avg(before), 6) AS baseline_recall, round(avg(after), 6) AS recall, CASE WHEN avg(before) - avg(after) > 0.05 + 1e-9 THEN 'regression' ELSE 'pass' END AS verdict FROM m""")
def regression_verdict(spark, d):
    m = _metrics(spark, d)
    out = evaluation.regression_verdict(m.filter("variant = 'bm25'"), m.filter("variant = 'rrf'"), 0.05)
    return out.withColumn("baseline_recall", F.round("baseline_recall", 6)).withColumn("recall", F.round("recall", 6))


@query("SELECT kind, count(*) AS questions, count(*) FILTER (len(gold) = 0) AS without_gold FROM questions GROUP BY kind")
def count_by_kind(spark, d):
    return table(spark, d, "questions").groupBy("kind").agg(F.count("*").alias("questions"), F.count_if(F.size("gold") == 0).alias("without_gold"))


_PATTERN = "array_to_string(list_transform(list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> ''), lambda w: '\\Q' || w || '\\E'), '\\s+')"
_BOOK = "(SELECT doc_id FROM pages GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 1)"


def _quotes(spark, d):
    """The opening words of every chunk that lies on one page, as labelled quotes."""
    chunks = table(spark, d, "chunks").filter("page_start = page_end").select("chunk_id", "doc_id", "page_start", "text").distinct()
    return chunks.select("doc_id", F.col("chunk_id").alias("qid"), F.lit(0).alias("gold_ix"), F.col("page_start").alias("page_no"), F.trim(F.substring("text", 1, 80)).alias("quote"))


@query(f"""WITH q AS (SELECT DISTINCT chunk_id AS qid, doc_id, page_start AS page_no, trim(substr(text, 1, 80)) AS quote FROM chunks WHERE page_start = page_end),
    j AS (SELECT q.*, p.text, p.char_start AS s, p.doc_id IS NULL AS gone, regexp_extract_all(p.text, {_PATTERN.format('quote')}) AS hits FROM q LEFT JOIN pages p ON p.doc_id = q.doc_id AND p.page_no = q.page_no),
    r AS (SELECT *, CASE WHEN gone THEN 'page-missing' WHEN len(hits) = 0 THEN 'quote-not-found' WHEN len(hits) > 1 THEN 'quote-ambiguous' END AS code, substr(text, 1, strpos(text, hits[1]) - 1) AS before FROM j)
    SELECT qid, page_no, code, cast(CASE WHEN code IS NULL THEN s + {units_sql('before')} END AS INTEGER) AS "start",
           cast(CASE WHEN code IS NULL THEN s + {units_sql('before')} + {units_sql('hits[1]')} END AS INTEGER) AS "end" FROM r""")
def gold_spans(spark, d):
    return evaluation.resolve_gold(_quotes(spark, d), table(spark, d, "pages")).select("qid", "page_no", "code", "start", "end")


def _book(spark, d):
    """The pages of the document with most pages, which stands for the labelled one."""
    pages = table(spark, d, "pages")
    first = pages.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(1)
    return pages.join(F.broadcast(first), "doc_id")  # one row


@query(f"""WITH p AS (SELECT * FROM pages WHERE doc_id = {_BOOK}), g AS (SELECT qid, unnest(gold) AS g FROM questions), t AS (SELECT qid, g.page AS page_no, g.quote AS quote FROM g),
    j AS (SELECT t.*, p.page_no IS NULL AS gone, len(regexp_extract_all(p.text, {_PATTERN.format('quote')})) AS n FROM t LEFT JOIN p USING (page_no)),
    d AS (SELECT qid, row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY qid) AS nth FROM questions)
    SELECT 'duplicate-question' AS code, qid FROM d WHERE nth > 1
    UNION ALL SELECT 'page-out-of-range', qid FROM t WHERE page_no > (SELECT count(*) FROM p)
    UNION ALL SELECT CASE WHEN gone THEN 'page-missing' WHEN n = 0 THEN 'quote-not-found' ELSE 'quote-ambiguous' END, qid FROM j WHERE gone OR n <> 1""")
def dataset_violations(spark, d):
    """The labelled questions against the longest document."""
    book = materialize(_book(spark, d))
    return evaluation.dataset_violations(table(spark, d, "questions"), book, book.count())


@query("SELECT cast(row_number() OVER (ORDER BY a.i, b.i) - 1 AS INTEGER) AS variant_no, a.v AS strategy, b.v AS rerank FROM (VALUES (0, 'dense'), (1, 'bm25'), (2, 'hybrid')) a(i, v), (VALUES (0, 'off'), (1, 'llm')) b(i, v)")
def variant_matrix(spark, d):
    return evaluation.expand_matrix(spark, {"strategy": ["dense", "bm25", "hybrid"], "rerank": ["off", "llm"]})


# --- events stand for model calls: value is the latency, the property k the tokens

_CALLS = """calls AS (SELECT event_id, user_id, ts, event_type AS model_id, CASE WHEN event_type IN ('view', 'click') THEN 'embed' ELSE 'model' END AS kind,
    cast(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, CASE WHEN value > 50 THEN NULL ELSE cast(floor(value) AS BIGINT) END AS output_tokens,
    event_type <> 'error' AS ok, value AS latency_ms FROM events)"""


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", "ts", F.col("event_type").alias("model_id"), F.when(F.col("event_type").isin("view", "click"), "embed").otherwise("model").alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("prompt_tokens"), F.when(F.col("value") <= 50, F.floor("value").cast("bigint")).alias("output_tokens"),
        (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"),
    )


@query(f"""WITH {_CALLS} SELECT kind, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, cast(sum(coalesce(prompt_tokens, 0)) AS BIGINT) AS prompt_tokens,
    cast(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, count(*) FILTER (kind = 'model' AND prompt_tokens IS NULL AND output_tokens IS NULL) AS without_tokens,
    round(sum(latency_ms), 4) AS latency_ms FROM calls GROUP BY kind""")
def usage_totals(spark, d):
    return accounting.usage_totals(_calls(spark, d)).withColumn("latency_ms", F.round("latency_ms", 4))


@query(f"""WITH {_CALLS}, prices(model_id, i, o) AS (VALUES ('error', 0.5, 1.5), ('purchase', 3.0, 15.0), ('view', 0.02, 0.0)),
    s AS (SELECT model_id, sum(prompt_tokens) AS p, sum(output_tokens) AS t FROM calls GROUP BY 1)
    SELECT model_id, round(coalesce((p * i + t * o) / 1e6, 0), 9) AS cost, cast(CASE WHEN i IS NULL THEN coalesce(p, 0) + coalesce(t, 0) ELSE 0 END AS BIGINT) AS unpriced_tokens FROM s LEFT JOIN prices USING (model_id)""")
def usage_cost(spark, d):
    prices = spark.createDataFrame([("error", 0.5, 1.5), ("purchase", 3.0, 15.0), ("view", 0.02, 0.0)], "model_id string, input_per_million double, output_per_million double")
    return accounting.usage_cost(_calls(spark, d), prices).withColumn("cost", F.round("cost", 9)).withColumn("unpriced_tokens", F.col("unpriced_tokens").cast("bigint"))


@query("SELECT user_id AS qid, round(max(epoch_us(ts) / 1000.0 + value), 3) AS total_ms, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def trace_totals(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("qid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("start_ms"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status")
    )
    return accounting.trace_totals(e).withColumn("total_ms", F.round("total_ms", 3))


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window,
    count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 1 AS over_limit FROM events""")
def rate_window(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return accounting.rate_window(e, "user_id", "ts", 3600, 1).select("event_id", "in_window", "over_limit")


@query("""SELECT event_type AS variant, count(*) AS questions, count(*) FILTER (value > 150) AS failed, count(*) FILTER (value <= 150 AND value < 5) AS refused,
    round(avg(CASE WHEN value <= 150 THEN value / 150 END), 6) AS recall, quantile_disc(CASE WHEN value <= 150 THEN value END, 0.5) AS p50_ms, quantile_disc(CASE WHEN value <= 150 THEN value END, 0.95) AS p95_ms FROM events GROUP BY 1""")
def variant_summary(spark, d):
    e = table(spark, d, "events").select(
        F.col("event_type").alias("variant"), F.when(F.col("value") > 150, "timeout").alias("error"), F.when(F.col("value") < 5, "low-score").alias("refusal"), (F.col("value") / 150).alias("recall"), F.col("value").alias("latency_ms")
    )
    return evaluation.variant_summary(e).withColumn("recall", F.round("recall", 6))


# --- ratings

_QKEY = "regexp_replace(trim(regexp_replace(lower(question), '\\s+', ' ', 'g')), '[?\\s]+$', '')"


@query("SELECT answer_id, arg_max(rating, line_no) AS rating, max(line_no) AS line_no FROM review_items GROUP BY answer_id")
def latest_per_answer(spark, d):
    return accounting.latest_per_answer(table(spark, d, "review_items").select("answer_id", "line_no", "rating"))


@query(f"SELECT {_QKEY} AS question_key, count(*) AS answers, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down FROM review_items GROUP BY 1")
def question_groups(spark, d):
    return accounting.question_groups(table(spark, d, "review_items"))


@query(f"SELECT line_no, answer_id FROM review_items WHERE {_QKEY} NOT IN (SELECT {_QKEY} FROM questions)")
def new_questions(spark, d):
    return accounting.known_questions(table(spark, d, "review_items"), table(spark, d, "questions")).select("line_no", "answer_id")


@query("SELECT line_no, cast(len(list(answer_id) OVER (PARTITION BY qid ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS BIGINT) AS turns FROM review_items WHERE qid IS NOT NULL")
def history_last_n(spark, d):
    turns = table(spark, d, "review_items").filter("qid IS NOT NULL").withColumnRenamed("question", "text")
    return accounting.last_turns(turns, "qid", "line_no", 4).select("line_no", F.when(F.size("history") > 0, F.size("history").cast("bigint")).alias("turns"))


# --- pages and offsets


@query(f"SELECT doc_id, page_no, cast(coalesce(sum({units_sql('text')} + 2) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page_start FROM pages")
def page_offsets(spark, d):
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    sized = table(spark, d, "pages").select("doc_id", "page_no", (utf16_units(F.col("text")) + 2).alias("n"))
    return sized.select("doc_id", "page_no", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("page_start"))


from . import catalog_more, catalog_text  # noqa: E402, F401  (register the queries of the other operators)
