"""Edits, promotion, reading aids, reports, ports and stores against hand-worked values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import filters, tokenizers
from lectern.functions import text as X
from lectern.operators import chunking, cleaning, edits, evaluation, models, promotion, query_text, reading, reports, structure
from lectern.plans.catalog_more import flat_edits
from lectern.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_edits_move_places():
    done = edits.Edited("abcdefghij", [(6, 8, ""), (2, 4, "XYZ")])
    assert done.text == "abXYZefij"
    assert [done.place(i, False) for i in (0, 2, 3, 4, 7, 8, 10)] == [0, 2, 5, 5, 7, 7, 9]
    assert (done.place(3, True), done.place(7, True), done.place(10, True)) == (2, 7, 9)
    with pytest.raises(ValueError):
        edits.Edited("abc", [(0, 2, ""), (1, 3, "")])


def test_edits_of_pages_and_items(spark):
    pages = spark.createDataFrame([("d", 1, "ab-\ncd 𝑞 ef"), ("d", 2, "gone")], "doc_id string, page_no int, text string")
    cuts = spark.createDataFrame([("d", 1, 2, 4, ""), ("d", 2, 0, 4, "")], "doc_id string, page_no int, start int, end int, replacement string")
    items = spark.createDataFrame([("d", 1, 0, "ab-", 0, 3, "F"), ("d", 1, 1, "𝑞 ef", 7, 12, "F"), ("d", 2, 0, "gone", 14, 18, "F")], "doc_id string, page_no int, item_no int, text string, start int, end int, font string")
    after, left = edits.apply_edits(pages, cuts, items)
    assert [(r.text, r.char_start, r.char_end) for r in after.orderBy("page_no").collect()] == [("abcd 𝑞 ef", 0, 10), ("", 12, 12)]
    assert [(r.item_no, r.text, r.start, r.end, r.font) for r in left.orderBy("item_no").collect()] == [(0, "ab", 0, 2, "F"), (1, "𝑞 ef", 5, 10, "F")]


def test_edits_of_a_function_stay_with_their_pages(spark):
    texts = {("d", 1): "a  b\n𝑞 \n c", ("d", 2): "", ("d", 3): " x ", ("e", 1): "one", ("e", 2): None}
    pages = spark.createDataFrame([(*k, t) for k, t in texts.items()], "doc_id string, page_no int, text string")
    own = [(*k, a, z, by) for k, t in texts.items() for a, z, by in flat_edits(chunking.as_units(t or ""))]
    table = spark.createDataFrame(own, "doc_id string, page_no int, start int, end int, replacement string")
    by_function, by_table = (edits.apply_edits(pages, e)[0] for e in (flat_edits, table))
    plan = by_function._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan
    assert sorted(by_function.collect()) == sorted(by_table.collect()) == [("d", 1, "a b 𝑞 c", 0, 8), ("d", 2, "", 10, 10), ("d", 3, " x ", 12, 15), ("e", 1, "one", 0, 3), ("e", 2, "", 5, 5)]


def test_a_batch_of_many_edits_is_held_in_slices():
    import tracemalloc

    import pyarrow as pa

    n, each = 4000, 200
    own = pa.StructArray.from_arrays([pa.array(list(range(0, 2 * each, 2)) * n, pa.int32()), pa.array(list(range(1, 2 * each, 2)) * n, pa.int32()), pa.array(["-"] * each * n)], ["start", "end", "replacement"])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(["d"] * n), "page_no": pa.array(range(n), pa.int32()), "text": pa.array([" x" * each] * n), "edits": pa.ListArray.from_arrays(pa.array(range(0, each * n + 1, each), pa.int32()), own)})
    tracemalloc.start()
    rows = 0
    for b in edits.edited_batches(iter([batch])):
        rows += b.num_rows
        assert set(b["text"].to_pylist()) == {"-x" * each}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 40e6  # the edits of the whole batch as objects are over 100 MB


def test_gold_is_resolved_within_its_document(spark):
    pages = spark.createDataFrame([("a", 1, "One two\n three. 𝑞 Four (five)", 0), ("b", 1, "One two three. One  two", 0)], "doc_id string, page_no int, text string, char_start int")
    gold = [("a", "x", 0, 1, "two three"), ("a", "x", 1, 1, "Four (five)"), ("b", "y", 0, 1, "One two"), ("b", "y", 1, 2, "One"), ("a", "z", 0, 1, "absent"), ("a", "z", 1, 1, " ")]
    rows = evaluation.resolve_gold(spark.createDataFrame(gold, "doc_id string, qid string, gold_ix int, page_no int, quote string"), pages).collect()
    got = {(r.qid, r.gold_ix): (r.start, r.end, r.code) for r in rows}
    assert got == {("x", 0): (4, 14, None), ("x", 1): (19, 30, None), ("y", 0): (None, None, "quote-ambiguous"), ("y", 1): (None, None, "page-missing"), ("z", 0): (None, None, "quote-not-found"), ("z", 1): (None, None, "quote-not-found")}


def test_ratings_become_questions(spark):
    pages = spark.createDataFrame([(1, "The belt wears out first.", 0), (2, "The pump follows.", 27)], "page_no int, text string, char_start int")
    c = "array<struct<number:bigint,page_start:int,page_end:int,quote:string>>"
    first, second, wide = (1, 1, 1, "The belt wears"), (2, 2, 2, "The pump follows."), (1, 1, 2, "The belt wears")
    rows = [
        ("a1", 1, "m", "Which parts?", "up", "Belt [1], pump [2].", None, [first, second]), ("a2", 2, "m", "which  PARTS", "up", "Belt [1].", None, [first]), ("a3", 3, "m", "Known one?", "up", "Belt [1].", None, [first]),
        ("a4", 4, "m", "Down?", "down", "Belt [1].", None, [first]), ("a5", 5, "m", "Declined?", "up", "", "no-results", []), ("a6", 6, "other", "Other?", "up", "x [1]", None, [first]), ("a7", 7, "m", "Wide?", "up", "Belt [1].", None, [wide]),
        ("a8", 8, "m", "No source?", "up", "Belt.", None, [first]), ("a9", 9, "m", "Single?", "up", "Belt [1].", None, [first]), ("a9", 10, "m", "Single?", "up", "Belt [1]!", None, [first]),
    ]
    ratings = spark.createDataFrame(rows, f"answer_id string, line_no bigint, doc_id string, question string, rating string, answer string, refusal string, citations {c}")
    known = spark.createDataFrame([("q007", "known one", "factual", "x", [(1, "y")])], "qid string, question string, kind string, answer string, gold array<struct<page:int,quote:string>>")
    done = promotion.classify(ratings, known, pages, "m")
    assert {r.answer_id: (r.outcome, r.reason) for r in done.collect()} == {
        "a1": ("add", "labelled"), "a2": ("skip", "known question"), "a3": ("skip", "known question"), "a4": ("review", "rated down"), "a5": ("add", "declined"),
        "a6": ("skip", "another document"), "a7": ("review", "no passage found"), "a8": ("skip", "no source"), "a9": ("add", "labelled"),
    }
    added = {r.qid: (r.kind, r.answer, len(r.gold)) for r in promotion.promote(done, known).collect()}
    assert added == {"q007": ("factual", "x", 1), "q008": ("multi-part", "Belt, pump.", 2), "q009": ("unanswerable", promotion.NOT_COVERED, 0), "q010": ("factual", "Belt!", 1)}
    assert one(spark, promotion.next_version(F.lit("v9"))) == "v10" and one(spark, promotion.next_version(F.lit("v1-smoke"))) is None


def test_question_ids_go_on_beyond_three_digits(spark):
    gold = "array<struct<gold_ix:int,page_no:int,quote:string>>"
    done = spark.createDataFrame([(f"a{i:02}", i, f"Question {i}?", "add", "declined", "", None) for i in range(1, 5)], f"answer_id string, line_no bigint, question string, outcome string, reason string, answer string, gold {gold}")
    known = spark.createDataFrame([("q997", "known", "factual", "x", []), ("q001-b", "other", "factual", "x", [])], "qid string, question string, kind string, answer string, gold array<struct<page:int,quote:string>>")
    rows = [(r.qid, r.question) for r in promotion.promote(done, known).orderBy(F.length("qid"), "qid").collect()]
    assert rows == [("q997", "known"), ("q998", "Question 1?"), ("q999", "Question 2?"), ("q1000", "Question 3?"), ("q1001", "Question 4?"), ("q001-b", "other")]
    with pytest.raises(Exception, match="question ids stop at q999"):
        promotion.promote(done, known, last_id=999).collect()


def test_outline_keys_and_trails(spark):
    tree = spark.createDataFrame([("d", 0, None, 1, "One", 1, 3), ("d", 1, 0, 2, "One A", 1, 2), ("d", 2, 0, 2, "One B", 2, 3), ("d", 3, None, 1, "Two", 3, 4)], "doc_id string, ord int, parent_ord int, level int, title string, page_start int, page_end int")
    assert {r.title: r.key for r in reading.outline_keys(tree).collect()} == {"One": "0", "One A": "0.0", "One B": "0.1", "Two": "1"}
    pages = spark.createDataFrame([("d", n) for n in range(1, 6)], "doc_id string, page_no int")
    got = {}
    for r in reading.active_trail(tree, pages).orderBy("level").collect():
        got.setdefault(r.page_no, []).append(r.title)
    assert got == {1: ["One", "One A"], 2: ["One", "One B"], 3: ["Two"], 4: ["Two"]}
    assert structure.outline(tree).first().outline == "One  (pp.1-3)\n  One A  (pp.1-2)\n  One B  (pp.2-3)\nTwo  (pp.3-4)"


def test_highlights_join_a_line(spark):
    items = spark.createDataFrame([("d", 1, 0, 10.0, 100.0, 50.0, 10.0, 0, 10), ("d", 1, 1, 62.0, 100.0, 50.0, 10.0, 11, 21), ("d", 1, 2, 10.0, 80.0, 50.0, 10.0, 22, 32)], "doc_id string, page_no int, item_no int, x double, y double, width double, font_size double, start int, end int")
    spans = spark.createDataFrame([("s", "d", 5, 27)], "span_id string, doc_id string, start int, end int")
    got = [(r.line_no, r.x, r.y, r.width, r.height) for r in reading.highlight_boxes(items, spans).orderBy("line_no").collect()]
    assert got == [(0, 35.0, 97.5, 77.0, 12.0), (1, 10.0, 77.5, 25.0, 12.0)]


def test_markdown_holds_the_text(spark):
    docs = spark.createDataFrame([("d", "Intro\n\nTitle\nbody text\n\nnext page")], "doc_id string, text string")
    pages = spark.createDataFrame([("d", 1, 0), ("d", 2, 24)], "doc_id string, page_no int, char_start int")
    tree = spark.createDataFrame([("d", 2, "Title", 7, 12)], "doc_id string, level int, title string, start int, title_end int")
    assert structure.markdown(docs, pages, tree).first().markdown == "<!-- page 1 -->\n\nIntro\n\n## Title\n\nbody text\n\n<!-- page 2 -->\n\nnext page\n"


def test_ports_retry_and_judge(spark):
    waits = []
    port = models.with_retries(models.Scripted({"x": "y"}, failures=2), sleep=waits.append)
    assert port("x") == "y" and len(waits) == 2 and waits[0] <= 0.5 and waits[1] <= 1.0
    with pytest.raises(models.Transient):
        models.with_retries(models.Scripted(failures=9), sleep=lambda s: None)("x")
    assert models.retry_delay(1, 500, 8000, 2, 0.5) == 250 and models.retry_delay(3, 500, 8000, 2, 0.5) is None and models.retry_delay(1, 500, 8000, 2, 0.1, 9000) is None
    answers = spark.createDataFrame([("a", "q", "good", "s"), ("b", "q", "none", "s"), ("c", "q", "bad", "s")], "id string, question string, answer string, sources string")
    replies = {"good": 'Sure: {"claims": [{"claim": "x", "verdict": "supported"}, {"claim": "y", "verdict": "partial"}]}', "none": '{"claims": []}', "bad": "no"}
    got = {r.id: r.faithfulness for r in models.judge_answers(answers, models.Scripted(replies), "{{question}} {{answer}} {{sources}}").collect()}
    assert got == {"a": 0.75, "b": None, "c": None}
    with pytest.raises(ValueError):
        models.fill("{{a}} {{a}}", a="x")
    assert one(spark, models.fill("<{{a}}|{{b}}>", a=F.lit("{{b}}"), b="y")) == "<{{b}}|y>"
    assert models.parse_template("rag-system.v2.txt", "a\r\n{{sources}}") == {"id": "rag-system", "version": "v2", "text": "a\n{{sources}}"}
    assert one(spark, models.user_message(F.lit("Why?"), F.lit(" "))) == "Why?" and "(page 3)" in one(spark, models.user_message(F.lit("Why?"), F.lit("text"), F.lit(3)))
    assert one(spark, models.retry_after_ms(F.lit("7"), F.current_timestamp())) == 7000 and one(spark, models.retry_after_ms(F.lit("soon"), F.current_timestamp())) is None
    assert one(spark, models.is_transient(F.lit(429))) and not one(spark, models.is_transient(F.lit(501)))


def test_queue_and_silence(spark):
    calls = spark.createDataFrame([("s", i, t, 500) for i, t in enumerate([0, 0, 0, 100, 5000])], "service string, call_id int, at int, lasts int")
    starts = lambda **k: [r.start_ms for r in models.queue_starts(calls, "service", "at", 1000, 2, **k).orderBy("call_id").collect()]
    assert starts() == [0, 0, 1000, 1000, 5000] and starts(running=1, duration="lasts") == [0, 500, 1000, 1500, 5000]
    deltas = spark.createDataFrame([("a", 0, False), ("a", 10, True), ("b", 0, False), ("b", 90, True), ("c", 0, False)], "reply string, at int, is_end boolean")
    assert {(r.reply, r.timed_out_at) for r in models.silent_after(deltas, "reply", "at", 50, 200).collect()} == {("b", 50), ("c", 50)}


def test_reports(spark):
    a = evaluation.Mulberry(1)
    both = np.concatenate([a.take(3), a.take(2)])
    assert np.allclose(both, evaluation.Mulberry(1).take(5)) and abs(both[0] - 0.6270739405881613) < 1e-12
    assert reports.picked_places(5, 9, 3) == [0, 1, 2, 3, 4] and len(set(reports.picked_places(1000, 20, 3))) == 20 and reports.seed_of("") == 0x811C9DC5
    s = spark.createDataFrame([("a", 10, 0, 1, 0.5, 10.0, 20.0), ("b", 10, 1, 0, 0.75, 12.0, 19.0)], "variant string, questions int, failed int, refused int, recall double, p50_ms double, p95_ms double")
    text = reports.experiment_report(s)
    assert "| b | 10 | 1 | 0 | **0.750** | 12.000 | **19.000** |" in text and "Failed questions" in text
    v = spark.createDataFrame([(0, 0, 3, 1, 0.8, 0.7, "regression")], "missing int, extra int, worse int, better int, baseline_recall double, recall double, verdict string")
    assert reports.regression_report(v, 0.05).startswith("regression: recall fell from 0.800 to 0.700")
    m = spark.createDataFrame([("x", "chat"), ("x:latest", "judge"), ("y:1", "chat")], "model string, purpose string")
    assert {tuple(r) for r in reports.models_needed(m).collect()} == {("x:latest", "chat, judge"), ("y:1", "chat")}


def test_rules_that_were_wrong(spark):
    assert one(spark, X.terms(F.lit("apple the apple"), stopwords=True)) == ["apple", "apple"]
    assert one(spark, X.terms(X.compatible(F.lit("ﬁne ＡＢ 𝑞 x²")))) == ["fine", "ab", "q", "x2"]
    assert one(spark, X.question_key(F.lit(" What  is this. ? "))) == "what is this."
    assert one(spark, query_text.clean_rewrite(F.lit("x" * 501))) is None and one(spark, query_text.clean_rewrite(F.lit(" \n"))) is None
    assert one(spark, query_text.clean_variants(F.lit("- Why?\n- how?"), 3, F.lit("why?"))) == ["how?"]
    assert [one(spark, X.money(F.lit(v))) for v in (0.0, 1.5, 0.0125, 0.00123)] == ["0", "1.50", "0.01", "0.00123"]
    assert one(spark, X.roman_text(F.lit(1994))) == "mcmxciv"
    lines = ["12", "Page iv", "- 7 -", "3 of 20", "page 4/9", "iiii", "12 apples", "12345", "page", "– 9"]
    rows = cleaning.printed_numbers(spark.createDataFrame([(l,) for l in lines], "line string")).collect()
    assert {r.line: (r.kind, r.value) for r in rows} == {"12": ("arabic", 12), "Page iv": ("roman", 4), "- 7 -": ("arabic", 7), "3 of 20": ("arabic", 3), "page 4/9": ("arabic", 4)}
    r = lambda h: tuple(one(spark, filters.byte_range(F.lit(h), F.lit(100).cast("bigint"))))
    assert [r("bytes=5-9"), r("bytes=90-"), r("bytes=-10"), r("bytes=200-"), r("bytes=9-5"), r("x")] == [("partial", 5, 9), ("partial", 90, 99), ("partial", 90, 99), ("unsatisfiable", None, None), ("whole", None, None), ("whole", None, None)]
    chunks = spark.createDataFrame([("a", "p"), ("p", None)], "chunk_id string, parent_id string")
    hits = spark.createDataFrame([("q", "a", 1.0, 1)], "qid string, chunk_id string, score double, rank int")
    from lectern.operators import retrieval

    assert retrieval.expand_parents(hits, chunks, 3).first().chunk_id == "p"
    with pytest.raises(Exception, match="no chunk or parent"):
        retrieval.expand_parents(hits, chunks.filter("chunk_id = 'a'"), 3).collect()
    results = spark.createDataFrame([("a", "q", 0.5, None), ("b", "q", 0.7, "timeout"), ("a", "r", 0.5, None), ("b", "r", 0.5, None)], "variant string, qid string, recall double, error string")
    got = evaluation.compare(results, "a", "recall").first()
    assert (got.wins, got.ties) == (0, 1)


def test_sizes_count_utf16_units(spark):
    text = "𝑞" * 30 + " ab. " + "c" * 50
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    fixed = chunking.fixed_size(docs, 5, 0).orderBy("chunk_no").collect()
    assert "".join(r.text for r in fixed) == text and all(len(r.text.encode("utf-16-le")) // 2 <= 20 and r.char_end - r.char_start == len(r.text.encode("utf-16-le")) // 2 for r in fixed)
    assert fixed[0].char_end == 20 and chunking.fixed_size(docs, 1, 0).count() == -(-115 // 4)
    spans = chunking.recursive(docs, 5, 0).collect()
    assert all(r.char_end - r.char_start <= 20 and "�" not in r.text for r in spans)


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "docs")
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    stores.save_documents(docs, folder)
    stores.save_documents(spark.createDataFrame([("b", "z")], docs.schema), folder)
    assert {(r.doc_id, r.text) for r in stores.load_documents(spark, folder).collect()} == {("a", "x"), ("b", "z")} and stores.list_documents(spark, folder).count() == 2
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, vector array<float>")
    stores.save_vectors(vectors, str(tmp_path / "v"), 2)
    assert stores.load_vectors(spark, str(tmp_path / "v")).count() == 2
    data = next((tmp_path / "v").glob("data-*"))
    vectors.limit(1).withColumn("chunk_id", F.lit("c")).write.mode("append").parquet(str(data))
    with pytest.raises(ValueError):
        stores.load_vectors(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError):
        stores.valid_batch(vectors.unionByName(vectors), 2)
    results = spark.createDataFrame([("a", "q", 0.5, 0.5, 1.0, None, None)], stores.RESULTS)
    stores.append_results(results, str(tmp_path / "e"))
    stores.append_results(results, str(tmp_path / "e"))
    assert stores.read_results(spark, str(tmp_path / "e")).count() == 2
    with pytest.raises(ValueError):
        stores.read_summary(spark, str(tmp_path / "e"))


def test_tokens_of_a_vocabulary_file(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([("Hello world, naïve 𝑞!",), (None,)], "t string")
    rows = df.select("t", tokenizers.token_count(F.col("t"), path).alias("n"), tokenizers.token_spans(F.col("t"), path).alias("s")).collect()
    assert rows[0].n == len(rows[0].s) > 4 and rows[0].s[0].start == 0 and rows[0].s[-1].end == len(rows[0].t) and rows[1].n is None
