"""The engine's own operators against hand-worked values and contracts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import filters, ids
from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.functions.cluster import approx_tokens, utf16_units
from lectern.operators import accounting, chunking, cleaning, context, evaluation, query_text, retrieval, structure
from lectern.plans import config
from lectern.sources import files, index_store

CHUNKS = "chunk_id string, doc_id string, text string, embed_text string, parent_id string, page_start int, page_end int, section_path array<string>, char_start int, char_end int, strategy string"


def chunk_rows(texts):
    return [(k, "doc", t, None, None, i + 1, i + 1, ["A", "B"], 10 * i, 10 * i + 9, "recursive") for i, (k, t) in enumerate(texts.items())]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(chunk_rows({"d1": "apple banana apple", "d2": "banana cherry", "d3": "cherry cherry cherry date"}), CHUNKS).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bm25_goldens(spark, small):
    q = spark.createDataFrame([("a", "apple cherry"), ("b", "banana banana"), ("c", "nothing here")], "qid string, question string")
    got = {(r.qid, r.chunk_id): r.score for r in retrieval.bm25_search(small, q, 5).collect()}
    want = {("a", "d1"): 1.34864, ("a", "d3"): 0.689339, ("a", "d2"): 0.544215, ("b", "d2"): 0.470004 * 1.157895, ("b", "d1"): 0.470004}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=2e-5) for k in want)
    only = retrieval.bm25_search(small, q, 5, filters.page_range(2, 2)).filter("qid = 'a'").collect()
    assert [(r.chunk_id, r.rank) for r in only] == [("d2", 1)] and math.isclose(only[0].score, 0.544215, abs_tol=2e-5)


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid string, chunk_id string, score double, rank int, retriever string")


def test_fusion_goldens(spark):
    lists = hits(spark, [("q", c, s, i + 1, "dense") for i, (c, s) in enumerate([("a", 0.9), ("b", 0.5), ("c", 0.1)])] + [("q", c, s, i + 1, "bm25") for i, (c, s) in enumerate([("b", 12.0), ("d", 6.0), ("a", 0.0)])])
    rrf = retrieval.rrf(lists, 10).orderBy("rank").collect()
    assert [r.chunk_id for r in rrf] == ["b", "a", "d", "c"] and math.isclose(rrf[0].score, 1 / 62 + 1 / 61, abs_tol=1e-6)
    weighted = retrieval.weighted_fusion(lists, {"dense": 0.7, "bm25": 0.3}, 10).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in weighted] == [("a", 0.7), ("b", 0.65), ("d", 0.15), ("c", 0.0)]
    single = retrieval.weighted_fusion(lists.filter("retriever = 'dense' AND rank = 1"), {"dense": 0.7, "bm25": 0.3}, 10).first()
    assert single.score == 1.0
    assert retrieval.fusion_problems(lists.unionByName(lists)).count() == 6


def test_dense_search_ties_filters_and_zero_vectors(spark):
    rows = [(f"c{i:02d}", [float(i % 3), 1.0, 0.0]) for i in range(9)] + [("zero", [0.0] * 3), ("twin", [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    q = spark.createDataFrame([("q", [0.0, 1.0, 0.0])], "qid string, qv array<float>")
    got = retrieval.dense_search(df, q, 4).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c00", "c03", "c06", "twin"] and all(r.score == 1.0 for r in got)
    assert retrieval.dense_search(df, q, 4, F.col("chunk_id") == "zero").first().score == 0.0
    assert retrieval.dense_search(df, q, 2, measure="euclidean").orderBy("rank").first().chunk_id == "c00"
    grown = retrieval.upsert(df, spark.createDataFrame([("twin", [9.0, 9.0, 9.0]), ("new", [1.0, 1.0, 1.0])], df.schema))
    assert grown.count() == 12 and retrieval.delete(grown, spark.createDataFrame([("new",), ("unknown",)], "chunk_id string")).count() == 11


def test_dense_search_of_many_queries_goes_in_blocks(spark, monkeypatch):
    rows = [(f"c{i:03d}", v.tolist()) for i, v in enumerate(np.random.default_rng(4).standard_normal((90, 8)))] + [("short", [1.0]), ("null", None)]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    q = df.select(F.col("chunk_id").alias("qid"), F.col("vector").alias("qv"))
    for measure in ("cosine", "euclidean"):
        monkeypatch.setattr(retrieval, "DRIVER_QUERIES", 10_000)
        whole = retrieval.dense_search(df, q, 5, measure=measure)
        monkeypatch.setattr(retrieval, "DRIVER_QUERIES", 40)
        monkeypatch.setattr(retrieval, "PRODUCT_CELLS", 200)
        blocks = retrieval.dense_search(df, q, 5, measure=measure)
        assert "Join" not in blocks._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(map(tuple, blocks.collect()))
        assert got == sorted(map(tuple, whole.collect())) and len(got) == 451


def test_clusters_find_near_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 32))
    rows = [(i, (centres[i % 10] + 0.2 * rng.standard_normal(32)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    exact = {(r.qid, r.chunk_id) for r in retrieval.dense_search(df, q, 10, id_col="vec_id", vector_col="embedding").collect()}
    near = {(r.qid, r.chunk_id) for r in retrieval.cluster_search(df, q, 10, "vec_id", "embedding", list_rows=30).collect()}
    assert len(exact & near) >= 0.95 * len(exact)


def test_lists_hold_recall_without_clusters(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).standard_normal((500, 64)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    exact = {(r.qid, r.chunk_id) for r in retrieval.dense_search(df, q, 10, id_col="vec_id", vector_col="embedding").collect()}
    near = {(r.qid, r.chunk_id) for r in retrieval.cluster_search(df, q, 10, "vec_id", "embedding", list_rows=100, share=0.8).collect()}
    assert len(near) == len(exact) == 100 and len(exact & near) >= 95


def test_rerank_keeps_order_where_a_score_is_missing(spark):
    h = hits(spark, [("p", "a", 3.0, 1, "x"), ("p", "b", 2.0, 2, "x"), ("q", "a", 3.0, 1, "x"), ("q", "b", 2.0, 2, "x")])
    s = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 5.0), ("q", "b", 5.0)], "qid string, chunk_id string, new_score double")
    got = retrieval.rerank(h, s, 5, all_or_nothing=True).orderBy("qid", "rank").collect()
    assert [(r.qid, r.chunk_id) for r in got] == [("p", "b"), ("p", "a"), ("q", "a"), ("q", "b")]


def test_metrics_goldens(spark):
    spans = [(90, 160), (200, 260), (420, 430), (0, 50), (150, 200)]
    h = spark.createDataFrame([("q", i + 1, "d", a, b) for i, (a, b) in enumerate(spans)], "qid string, rank int, doc_id string, start int, end int")
    g = spark.createDataFrame([("q", 0, "d", 100, 160), ("q", 1, "d", 425, 440)], "qid string, gold_ix int, doc_id string, start int, end int")
    judged = evaluation.judge(h, g)
    counts = spark.createDataFrame([("q", 2), ("none", 0), ("missed", 1)], "qid string, golds int")
    at = lambda k: evaluation.retrieval_metrics(judged, counts, k).filter("qid = 'q'").first()
    five = at(5)
    assert (five.hit, five.recall, five.mrr) == (1.0, 1.0, 1.0) and math.isclose(five.ndcg, 0.91972, abs_tol=1e-5)
    two = at(2)
    assert (two.precision, two.recall) == (0.5, 0.5) and math.isclose(two.ndcg, 0.61315, abs_tol=1e-5)
    assert at(1).ndcg == 1.0
    rows = evaluation.retrieval_metrics(judged, counts, 5)
    assert {r.qid for r in rows.collect()} == {"q", "missed"} and rows.filter("qid = 'missed'").first().ndcg == 0.0
    assert evaluation.nearest_rank([5, 1, 3], 0.5) == 3 and evaluation.nearest_rank([], 0.5) == 0.0


def test_comparison_and_regression(spark):
    rows = [("a", f"q{i}", i / 10) for i in range(10)] + [("b", f"q{i}", i / 10 + 0.1) for i in range(10)]
    df = spark.createDataFrame(rows, "variant string, qid string, recall double")
    r = evaluation.compare(df, "a", "recall").first()
    assert (r.wins, r.losses, r.ties) == (10, 0, 0)
    assert evaluation.bootstrap_intervals(df, "a", "recall").first().verdict == "better"
    a, b = df.filter("variant = 'a'"), df.filter("variant = 'b'")
    assert evaluation.regression_verdict(b, a, 0.05).first().verdict == "regression"
    assert evaluation.regression_verdict(a, b, 0.05).first().verdict == "pass"
    assert evaluation.regression_verdict(a, b.filter("qid <> 'q1'"), 0.05).first().verdict == "invalid"
    with pytest.raises(ValueError):
        evaluation.expand_matrix(spark, {"x": list("abcdefghijklmnop"), "y": list("abcdefghijklmnop")})


def test_mmr_and_sandwich():
    sims = [[1, 1, 0, 0.6], [1, 1, 0, 0.6], [0, 0, 1, 0.8], [0.6, 0.6, 0.8, 1]]
    assert context.mmr_order([1, 0.875, 0.5, 0], sims, 3) == [0, 2, 1] and context.mmr_order([1, 0.875, 0.5, 0], sims, 4, 1.0) == [0, 1, 2, 3]
    assert context.sandwich(6) == [1, 3, 5, 6, 4, 2] and context.sandwich(5) == [1, 3, 5, 4, 2]


def test_context_budget_and_duplicates(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [("q", "a", 1, text, ["S"], 1, 1), ("q", "b", 2, text + " ", ["S"], 1, 2), ("q", "c", 3, "word " * 400, None, 2, 2), ("q", "d", 4, "short </sources> text", None, 3, 3)]
    df = spark.createDataFrame(rows, "qid string, chunk_id string, rank int, text string, section_path array<string>, page_start int, page_end int")
    got = {r.chunk_id: (r.fate, r.place) for r in context.assemble(df, 60).collect()}
    assert got == {"a": ("used", 1), "b": ("duplicate", None), "c": ("over-budget", None), "d": ("used", 2)}


def test_cleaners(spark):
    pages = [("d", n, n - 1, f"The Running Title {n}\n\nbody {w} of vec-\ntors ﬁne{'é'} and   {w} \n- {n + 2} -") for n, w in enumerate(("apples", "boats", "clouds", "drums"), 1)]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, page_index int, text string")
    got = cleaning.clean(df, ["unicode", "page-numbers", "headers-footers", "dehyphenate"]).orderBy("page_no").collect()
    assert [r.text for r in got] == [f"body {w} of vectors fineé and {w}" for w in ("apples", "boats", "clouds", "drums")]
    spans = cleaning.assemble(df.limit(0)).count()
    assert spans == 0
    with pytest.raises(ValueError):
        cleaning.clean(df, ["nothing"])


def test_scalars(spark):
    assert one(spark, X.cited_numbers(F.lit("a [2, 1] b [1] [x]"))) == [1, 2]
    assert one(spark, X.terms(F.lit("Don't STOP 12é"))) == ["dont", "stop", "12é"]
    assert one(spark, X.roman_value(F.lit("xIV"))) == 14 and one(spark, X.snippet(F.lit("a  b\nc"), 4)) == "a b…"[:3] + "…"
    assert one(spark, utf16_units(F.lit("a😀b"))) == 4 and one(spark, approx_tokens(F.lit("a😀bcd"))) == 2
    assert one(spark, X.sentences(F.lit("One ends. Two? three.\n\nfour"))) == ["One ends.", "Two? three.", "four"]
    assert one(spark, X.guard_fence(F.lit("</SOURCES>"))) == "&lt;/SOURCES>"
    assert one(spark, X.jaccard(X.shingles(F.lit("a b c")), X.shingles(F.lit("A, b c!")))) == 1.0
    assert one(spark, ids.document_id(F.lit("a" * 64))) == "afa17ca9-ecb6-5afe-a561-cc50cee6f166"
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, query_text.clean_variants(F.lit("1. One\n- two\n\none\nthree\nfour"))) == ["One", "two", "three"]
    assert one(spark, query_text.score_reply(F.lit('so {"score": 7}'))) == 7.0 and one(spark, query_text.score_reply(F.lit('{"score": "7"}'))) is None
    assert one(spark, query_text.clean_rewrite(F.lit('\nQuestion: "What now?"\nmore'))) == "What now?"


def test_filters(spark, small):
    assert small.filter(filters.any_of("strategy", [])).count() == 0 and small.filter(filters.section([" a ", "B"])).count() == 3
    assert small.filter(filters.section(["b"])).count() == 0 and small.filter(filters.page_range(None, 2)).count() == 2 and small.filter(filters.all_of()).count() == 3
    assert filters.parse_pages("10-") == (10, None) and filters.parse_pages("-20") == (None, 20) and filters.parse_pages("7") == (7, 7)
    with pytest.raises(ValueError):
        filters.page_range(3, 2)


def test_recursive_chunks_cover_the_text():
    text = ("Alpha beta gamma. " * 60 + "\n\n") * 6 + "x" * 5000
    spans = chunking.split_recursive(text, 100, 20)
    assert all(-(-(b - a) // 4) <= 100 for a, b in spans)
    seen = set().union(*(range(a, b) for a, b in spans))
    assert all(text[i].isspace() for i in range(len(text)) if i not in seen)
    assert chunking.split_recursive("", 100, 20) == [] and chunking.split_recursive("  ", 100, 20) == []
    semantic = chunking.split_semantic(text[:3000], 100, 20)
    assert all(-(-(b - a) // 4) <= 100 for a, b in semantic)


def test_chunkers_on_tables(spark):
    docs = spark.createDataFrame([("a", "word " * 900), ("b", None), ("c", ""), ("d", "1 Title\n" + "text. " * 300 + "\n2 Next\nmore")], "doc_id string, text string")
    fixed = chunking.fixed_size(docs, 100, 20).filter("doc_id = 'a'").orderBy("chunk_no").collect()
    assert fixed[0].char_end == 400 and fixed[1].char_start == 320 and fixed[-1].char_end == 4500
    pairs = chunking.parent_child(docs, 200, 50).collect()
    assert {r.doc_id for r in pairs} == {"a", "d"} and any(r.parent_no is None for r in pairs)
    assert chunking.structure_aware(docs, 100, 10).filter("text LIKE '2 Next%'").count() == 1
    assert chunking.recursive(docs.limit(0)).count() == 0


def test_structure(spark):
    rows, pos = [], 0
    for page, lines in ((1, [("Preface", 12, False), ("Chapter One", 24, True), ("alpha beta gamma delta", 12, False)]), (2, [("1.1 Sub", 16, True), ("delta epsilon zeta", 12, False), ("Chapter Two", 24, True), ("eta theta iota", 12, False)])):
        for i, (text, size, bold) in enumerate(lines):
            rows.append(("d", page, i, text, 72.0, 700.0 - 30 * i, float(size), bold, pos, pos + len(text)))
            pos += len(text) + 1
    items = spark.createDataFrame(rows, "doc_id string, page_no int, item_no int, text string, x double, y double, font_size double, is_bold boolean, start int, end int")
    titles = structure.merge_wrapped(structure.heading_lines(structure.group_lines(items)))
    tree = structure.sections(titles, spark.createDataFrame([("d", pos)], "doc_id string, length int"))
    got = [(r.title, r.level, r.parent_ord) for r in tree.orderBy("ord").collect()]
    assert got == [("Chapter One", 1, None), ("1.1 Sub", 2, 0), ("Chapter Two", 1, None)]
    at = next(r[8] for r in rows if r[3].startswith("delta"))
    paths = {r.position: r.path for r in structure.section_paths(spark.createDataFrame([("d", at), ("d", 1)], "doc_id string, position int"), tree).collect()}
    assert paths == {at: ["Chapter One", "1.1 Sub"], 1: []}
    assert structure.outline(tree).first().outline == "Chapter One\n  1.1 Sub\nChapter Two"


def test_accounting(spark):
    log = spark.createDataFrame([("a", 1, "up"), ("a", 5, "down"), ("b", 2, "up")], "answer_id string, line_no bigint, rating string")
    assert {(r.answer_id, r.rating) for r in accounting.latest_per_answer(log).collect()} == {("a", "down"), ("b", "up")}


def test_index_round_trip(spark, small, tmp_path):
    posted = retrieval.postings(small)
    tables = {"chunks": small, "postings": posted, "lengths": retrieval.chunk_lengths(small, posted), "vectors": small.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))}
    folder = str(tmp_path / "index")
    assert not index_store.is_current(spark, folder, {"a": 1})
    index_store.write_index(folder, tables, {"a": 1})
    assert index_store.is_current(spark, folder, {"a": 1}) and not index_store.is_current(spark, folder, {"a": 2})
    assert index_store.read_index(spark, folder, 2)["chunks"].count() == 3
    with pytest.raises(ValueError):
        index_store.read_index(spark, folder, 3)
    old = index_store.read_manifest(spark, folder)["tables"]
    index_store.write_index(folder, tables, {"a": 2})  # replaces the index, and the old tables go
    now = index_store.read_manifest(spark, folder)["tables"]
    assert now != old and index_store.is_current(spark, folder, {"a": 2}) and not (tmp_path / "index" / old).exists()
    broken = {**tables, "vectors": small.select(F.raise_error(F.lit("no")).cast("string").alias("chunk_id"), F.array(F.lit(1.0)).alias("vector"))}
    with pytest.raises(Exception):
        index_store.write_index(folder, broken, {"a": 3})
    assert index_store.is_current(spark, folder, {"a": 2}) and index_store.read_index(spark, folder, 2)["chunks"].count() == 3
    spark.read.parquet(f"{folder}/{now}/chunks").limit(1).write.mode("append").parquet(f"{folder}/{now}/chunks")
    with pytest.raises(ValueError):
        index_store.read_index(spark, folder)


def test_embedding_cache_embeds_only_what_it_lacks(spark):
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, text string")
    cache = spark.createDataFrame([], "key string, vector array<double>")
    embed = lambda df: df.select("key", F.array(F.length("text").cast("double")).alias("vector"))
    vectors, grown = index_store.embed_with_cache(texts, cache, embed)
    assert vectors.count() == 3 and grown.count() == 2


def test_json_lines_and_pdf(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"qid":"q001","kind":"factual"}\nnot json\n\n{"qid":"q002"}\n')
    good, bad = files.read_lenient(spark, str(path), "qid string, kind string")
    assert {r.qid for r in good.collect()} == {"q001", "q002"} and [r.line_no for r in bad.collect()] == [2]
    with pytest.raises(Exception):
        files.read_strict(spark, str(path), "qid string, kind string").collect()
    pdf = b"%PDF-1.4\n1 0 obj << /Length 9 >>\nstream\nBT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -20 Td (next line) Tj ET\nendstream\nendobj\n"
    (tmp_path / "a.pdf").write_bytes(pdf)
    assert files.read_pdfs(spark, str(tmp_path)).first().text == "Hello (PDF)\nnext line"


def test_config_layers():
    got = config.load({"retrieval": {"k": 7}}, {"RAG_CHUNKING__MAX_TOKENS": "200", "RAG_QUERY_TRANSFORM__HISTORY_TURNS": "2"}, {"--retrieval.k": "9"})
    assert got["retrieval"]["k"] == 9 and got["chunking"]["maxTokens"] == 200 and got["queryTransform"]["historyTurns"] == 2
    with pytest.raises(ValueError, match="unknown setting.*unknown setting"):
        config.load({"a": {"b": 1}}, None, {"--c.d": "1"})


def test_entry_point_has_sql_for_known_queries_only():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
