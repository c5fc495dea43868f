"""Operators of the training-data problems on small tables, against brute force and on odd input."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import crf, hyperlang, languages, mixing, neighbours, packing, pair_defects, scan_repair, site_lines, splitting

PARSED = "doc_id string, source string, title string, scanned boolean, text string"
PAGES = "doc_id string, page_no int, text string"


# --- 1: site lines


def _site_rows():
    rng = random.Random(1)
    docs, pages = [], []
    for i in range(40):
        source = None if i % 10 == 0 else "abc"[i % 3]
        lines = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(6)) for _ in range(5)]
        if i % 2:
            lines.insert(2, rng.choice(["Share this page!", "SHARE THIS  PAGE", "• share th​is page 12", "sharethis page"]))
        lines += ["short", "", "Share this page" if i % 7 == 0 else "12345678"]
        docs.append((f"d{i}", source, None, i % 13 == 0, "\n".join(lines)))
        pages.append((f"d{i}", 1, "\n".join(lines)))
    return docs, [*pages, ("gone", 1, "Share this page"), ("d1", 2, None)]


def test_site_lines_match_brute_force(spark):
    docs, pages = _site_rows()
    parsed = spark.createDataFrame(docs, PARSED)
    got = {tuple(r) for r in site_lines.found_lines(spark.createDataFrame(pages, PAGES), parsed).collect()}
    plain = {d[0]: d for d in docs if not d[3]}
    size, cover, at = defaultdict(int), defaultdict(set), defaultdict(set)
    for d in plain.values():
        size[d[1]] += 1
    for doc, no, text in pages:
        for i, line in enumerate((text or "").split("\n")):
            key = "".join(c for c in line.casefold() if c.isalpha())
            if doc in plain and len(key) >= 6:
                cover[plain[doc][1], key].add(doc)
                at[plain[doc][1], key].add((doc, no, i))
    want = set().union(*(at[k] for k, v in cover.items() if len(v) >= 3 and 10 * len(v) >= size[k[0]]))
    assert got == want and want
    cleaned = {r.doc_id: r for r in site_lines.without_site_lines(parsed).collect()}
    assert set(cleaned) == set(plain)
    assert "share" not in cleaned["d1"].text.lower() and cleaned["d1"].removed == 1


def test_site_templates_have_wildcards(spark):
    rows = [(f"d{i}", "s", None, False, f"By {'abcdefgh'[i] * 4} of the press, staff writer\n{'klmnopqr'[i] * 9} body") for i in range(8)]
    df = spark.createDataFrame(rows, PARSED)
    found = {r.template: r for r in site_lines.site_templates(df).collect()}
    assert found["by <*> of the press staff writer"].documents == 8 and found["by <*> of the press staff writer"].wordings == 8
    assert all("staff" not in r.text and (r.removed, r.by_template) == (1, 1) for r in site_lines.without_site_lines(df, templates=True).collect())
    assert all(r.removed == 0 for r in site_lines.without_site_lines(df).collect())  # no wording repeats: nothing is found, nothing removed


def test_site_line_whose_words_are_parted_differently(spark):
    ways = ["share this page", "sharethis page", "share thispage", "sharethispage"]
    parsed = spark.createDataFrame([(f"d{i}", "s", None, False, w) for i, w in enumerate(ways)], PARSED)
    pages = spark.createDataFrame([(f"d{i}", 1, w) for i, w in enumerate(ways)], PAGES)
    assert site_lines.site_templates(parsed).count() == 0
    assert [r.documents for r in site_lines.site_wordings(parsed).collect()] == [4]
    assert site_lines.found_lines(pages, parsed).count() == 4


def test_found_and_removed_lines_are_the_same(spark):
    docs, _ = _site_rows()
    parsed = spark.createDataFrame(docs, PARSED)
    pages = parsed.select("doc_id", F.lit(1).alias("page_no"), "text")
    found = {r.doc_id: r.n for r in site_lines.found_lines(pages, parsed).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r.doc_id: r.removed for r in site_lines.without_site_lines(parsed).collect() if r.removed} == found and found


def test_lines_that_share_a_node_are_told_apart(spark):
    # one covering node, a wildcard between its ends; only one of its wordings covers enough documents
    lines = ["Printed for readers in may"] * 3 + ["Printed by others in may!"[:14] + f" {'qwertyu'[i]}eaders in may" for i in range(5)]
    rows = [(f"d{i}", "s", None, False, l) for i, l in enumerate(lines)]
    parsed = spark.createDataFrame(rows, PARSED)
    found = {r.doc_id for r in site_lines.found_lines(parsed.select("doc_id", F.lit(1).alias("page_no"), "text"), parsed).collect()}
    assert found == {"d0", "d1", "d2"}


def test_site_lines_of_nothing(spark):
    none = spark.createDataFrame([], PARSED)
    assert site_lines.found_lines(spark.createDataFrame([], PAGES), none).count() == 0
    assert site_lines.without_site_lines(none).count() == 0


# --- 2: neighbours


def _vector_rows(n=400, dim=64):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, dim))
    rows = [(f"v{i:04d}", (centres[i % 12] + 0.3 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[5][1]
    rows += [(f"w{i:02d}", same) for i in range(14)] + [("scaled", [2 * x for x in rows[6][1]])]
    rows += [("null", None), ("short", [1.0]), ("zero", [0.0] * dim), ("nan", [float("nan")] * dim), ("hole", [None] * dim), rows[0], rows[0]]
    return rows


def test_nearest_recall_and_ties(spark):
    rows = _vector_rows()
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, 10).orderBy("id", "place").collect():
        got[r.id].append((r.neighbour, r.cosine))
    usable = {k: v for k, v in rows if k not in ("null", "short", "zero", "nan", "hole")}
    ids = sorted(usable)
    m = np.array([usable[k] for k in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -9)
    hit = 0
    for i, k in enumerate(ids):
        assert len(got[k]) == 10 and k not in [x for x, _ in got[k]]
        want = np.sort(sims[i])[::-1][:10]
        hit += sum(c >= want[-1] - 1e-9 for _, c in got[k])
    assert set(got) == set(ids) and hit / (10 * len(ids)) >= 0.9
    assert [x for x, _ in got["w00"]] == ["v0005", *[f"w{i:02d}" for i in range(1, 10)]]


def test_ties_between_classes_go_to_the_smaller_id(spark, monkeypatch):
    rng = np.random.default_rng(8)
    one = rng.standard_normal(64).astype(np.float32)
    names = [f"c{i:02d}" for i in range(40)]
    rows = [(name, (one * np.float32(2.0 ** (i - 20))).tolist()) for i, name in enumerate(names)]
    rng.shuffle(rows)
    rows += [(f"x{i:02d}", rng.standard_normal(64).astype(np.float32).tolist()) for i in range(60)]
    df = spark.createDataFrame([(r[0], [float(x) for x in r[1]]) for r in rows], "chunk_id string, vector array<float>").repartition(4)
    for cell in (2048, 6):  # one list, then a cluster that no centroid parts is asked in groups
        monkeypatch.setattr(neighbours, "CELL", cell)
        got = defaultdict(list)
        for r in neighbours.nearest(df, 10).orderBy("id", "place").collect():
            got[r.id].append(r.neighbour)
        assert all(got[name] == [n for n in names if n != name][:10] for name in names)


def _brute(rows, k):
    ids = sorted(rows)
    m = np.array([rows[i] for i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sims = m @ m.T
    np.fill_diagonal(sims, -9)
    return ids, sims, {ids[i]: [ids[j] for j in np.lexsort((np.arange(len(ids)), -np.round(sims[i], 6)))[:k]] for i in range(len(ids))}


def test_recall_over_many_lists_and_a_deep_tree(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((25, 64))
    rows = {f"v{i:05d}": (centres[int(25 * rng.random() ** 2)] + 0.7 * rng.standard_normal(64)).astype(np.float32).tolist() for i in range(3000)}
    monkeypatch.setattr(neighbours, "CELL", 60)
    monkeypatch.setattr(neighbours, "FAN", 8)
    grown = []
    grow = neighbours.grow_tree
    monkeypatch.setattr(neighbours, "grow_tree", lambda *a: grown.append(grow(*a)) or grown[-1])
    df = spark.createDataFrame(list(rows.items()), "chunk_id string, vector array<float>").repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest(df, 10).orderBy("id", "place").collect():
        got[r.id].append(r.neighbour)
    leaves = grown[0].size - len(grown[0].fans)
    assert leaves >= 20 and len(grown[0].fans) > 1  # lists below lists
    ids, sims, want = _brute(rows, 10)
    assert sum(len(set(got[i]) & set(want[i])) for i in ids) >= 0.9 * 10 * len(ids)


def test_close_pairs_over_many_lists_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((300, 64))
    rows = {f"v{i:05d}": (centres[i % 300] + rng.choice([0.05, 0.25, 0.34]) * rng.standard_normal(64)).astype(np.float32).tolist() for i in range(1500)}
    rows |= {f"w{i:03d}": rows["v00007"] for i in range(30)}  # a class with more members than travel
    monkeypatch.setattr(neighbours, "CELL", 50)
    df = spark.createDataFrame(list(rows.items()), "chunk_id string, vector array<float>").repartition(5)
    got = {tuple(r) for r in neighbours.close_pairs(df, 10).collect()}
    ids, sims, near = _brute(rows, 10)
    at = {k: i for i, k in enumerate(ids)}
    want = {tuple(sorted((a, b))) for a in ids for b in near[a] if sims[at[a], at[b]] >= 0.9}
    assert len(want) > 500 and got <= want and len(got) >= 0.99 * len(want)
    assert {p for p in want if "w0" in p[0] + p[1]} == {p for p in got if "w0" in p[0] + p[1]}


def test_adaptive_scan_keeps_nine_of_ten():
    rng = np.random.default_rng(1)
    u = neighbours._unit(rng.standard_normal((300, 64)))
    ids = np.arange(300)
    q, hit, cos = neighbours.adaptive_scan(u, ids, u, ids, np.full(300, -np.inf), 5)
    sims = u @ u.T
    np.fill_diagonal(sims, -9)
    want = np.argsort(-sims, axis=1)[:, :5]
    assert sum(len(set(want[i]) & set(hit[q == i])) for i in range(300)) >= 0.9 * 1500


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "chunk_id string, vector array<float>")
    assert neighbours.nearest(df, 3).count() == 0
    assert neighbours.nearest(spark.createDataFrame([("a", [1.0] * 64)], "chunk_id string, vector array<float>"), 3).count() == 0


# --- 3: splitting

CHUNKS = "chunk_id string, doc_id string, text string, char_start int, char_end int, piece_no int"


def test_split_text_covers_and_overlaps():
    rng = random.Random(5)
    for _ in range(60):
        words = ["".join(rng.choice("abcdé𝑞") for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", ".", ",", "\n\n"]) for _ in range(rng.randrange(1, 400))]
        text = " ".join(words)
        limit, overlap = 200, rng.choice([0, 40])
        spans = splitting.split_text(text, limit, overlap)
        units = lambda s: len(s.encode("utf-16-le")) // 2
        solid = set()
        for (a, b), nxt in zip(spans, [*spans[1:], None]):
            assert units(text[a:b]) <= limit
            solid |= set(range(a, b))
            if nxt:
                assert nxt[0] > a and units(text[nxt[0] : b]) <= overlap
        assert all(c.isspace() for i, c in enumerate(text) if i not in solid)
    assert splitting.split_text("x" * 1000, 300, 0) == [(0, 300), (300, 600), (600, 900), (900, 1000)]
    assert splitting.split_text(" " * 50, 10, 0) == [(0, 0)]


def test_split_oversized_places_pieces(spark):
    source = "Alpha 𝑞 beta. " * 200 + "\n\n" + "Gamma delta epsilon. " * 900
    text = re.sub(r"\s+", " ", source).strip()
    units = len(source.encode("utf-16-le")) // 2
    rows = [("c", "d", text, 0, units, 1), ("c", "d", text, 0, units, 1), ("lost", "nowhere", text, 0, units, 1), ("small", "d", "Alpha", 0, 5, 1), ("null", "d", None, 0, 5, 1)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    docs = spark.createDataFrame([("d", source), ("e", None)], "doc_id string, text string")
    got = splitting.split_oversized(chunks, docs, 100, 10).orderBy("chunk_id", "piece_no").collect()
    assert {r.chunk_id for r in got} == {"c", "lost"} and max(r.tokens for r in got) <= 100
    raw = source.encode("utf-16-le")
    for r in got:
        if r.chunk_id == "c":
            assert raw[2 * r.char_start : 2 * r.char_end].decode("utf-16-le").split() == r.text.split()
        else:
            assert r.char_start is None
    assert splitting.split_oversized(chunks.limit(0), docs, 100, 10).count() == 0


# --- 4: pairs


@pytest.fixture(scope="session")
def profiles():
    return hyperlang.train({k: [v] for k, v in languages._SEED.items()})


def test_crf_learns_its_examples():
    field = pair_defects.train()
    wrong = 0
    for question, parts, tags in pair_defects._EXAMPLES:
        path = pair_defects.tag(field, question, list(parts), [t == "f" for t in tags])
        wrong += "".join("arefu"[i] for i in path) != tags
    assert wrong <= 1


def test_refusals_in_words_that_were_not_trained_on():
    field = pair_defects.train()
    told = ["I have no idea.", "That goes beyond what I am allowed to discuss.", "It is outside the scope of my knowledge.", "You would have to ask someone else about that."]
    assert not set(told) & {r.strip() for r in pair_defects._REFUSALS}
    for text in told:
        assert pair_defects.tag(field, "Which parts wear out?", [text], [False]) == [1], text
    for text in ("The belt wears out first.", "Nothing wears out before the pump does.", "You should oil the belt, as the sources of dust are many."):
        assert pair_defects.tag(field, "Which parts wear out?", [text], [False]) == [0], text


def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    lengths, k = [3, 1, 2], 3
    em, step, start = rng.standard_normal((6, k)), rng.standard_normal((k, k)), rng.standard_normal(k)
    starts = np.cumsum(lengths) - lengths
    held = np.arange(3)[None] < np.array(lengths)[:, None]
    node, pairs, first = crf._marginals(em, np.where(held, starts[:, None] + np.arange(3)[None], 0), held, step, start)
    want, follow = np.zeros((6, k)), np.zeros((k, k))
    for a, n in zip(starts, lengths):
        ways = {y: np.exp(start[y[0]] + sum(em[a + i, y[i]] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n))) for y in itertools.product(range(k), repeat=n)}
        for y, w in ways.items():
            for i in range(n):
                want[a + i, y[i]] += w / sum(ways.values())
            for i in range(1, n):
                follow[y[i - 1], y[i]] += w / sum(ways.values())
    assert np.allclose(node, want) and np.allclose(pairs, follow) and np.allclose(first, want[starts].sum(axis=0))


def test_short_complete_answers_are_told_from_cuts():
    """Held-out: cuts at random are unfinished, a frequent kind of short answer is not."""
    rng = random.Random(7)
    nouns = "engine belt pump casing fan valve spring lever wheel gear shaft clutch".split()
    sentence = lambda: f"The {rng.choice(nouns)} moves the {rng.choice(nouns)} and the {rng.choice(nouns)} before every {rng.choice(nouns)} stops."
    rows = []
    for i in range(600):
        q = f"Which part moves the {rng.choice(nouns)}?"
        if i % 5 == 0:
            rows.append((q, [f"Roughly {rng.randrange(100)} to {rng.randrange(100)} percent of all"], [False], False))
        else:
            rows.append((q, [sentence() for _ in range(rng.randrange(3, 6))], [False] * 5, False))
    rows = [(q, p, f[: len(p)], t) for q, p, f, t in rows]
    field = pair_defects.train(rows[:400])
    whole = right = cut = 0
    for q, parts, foreign, _ in rows[400:]:
        if len(parts) == 1:
            whole += 1
            right += pair_defects.tag(field, q, parts, foreign) == [0]
        else:
            broken = [*parts[:-1], parts[-1][: rng.randrange(10, len(parts[-1]) - 2)].rstrip()]
            cut += pair_defects.tag(field, q, broken, foreign)[-1] == 4 and pair_defects.tag(field, q, parts, foreign)[-1] == 0
    assert right >= 0.95 * whole and cut >= 0.95 * (200 - whole)


def test_pair_defects(spark, profiles):
    q = "How do all human beings act towards one another?"
    rows = [
        ("ok", q, "They act in a spirit of brotherhood.", None), ("empty1", q, None, None), ("empty2", q, " [1] [2]", ""), ("empty3", q, "N/A", None), ("reason", q, "", "off-topic"),
        ("refused", q, "Sorry, I cannot answer that question.", None), ("copied", q, q.upper(), None), ("both", q, q + " They act in a spirit of brotherhood.", None),
        ("cut", q, "They act in a spirit. Human beings are endowed wi", None), ("short", q, "About 12 [3]", None), ("ok", q, "They act in a spirit of brotherhood.", None),
        ("foreign", q, "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft begabt.", None), (None, None, "Something is said.", None),
    ]
    items = spark.createDataFrame(rows, "answer_id string, question string, given string, refusal string")
    asked = spark.createDataFrame([("q1", q, "unanswerable", "I cannot answer that question."), ("q2", q, "factual", "I cannot answer that question.")], "qid string, question string, kind string, answer string")
    got = {(r.item_table, r.item_id): r.defect for r in pair_defects.defective_pairs(items, asked, profiles).collect()}
    want = {"empty1": "empty", "empty2": "empty", "empty3": "empty", "reason": "refusal", "refused": "refusal", "copied": "copy", "cut": "truncated", "foreign": "language"}
    assert got == {("review_items", k): v for k, v in want.items()} | {("questions", "q2"): "refusal"}
    assert pair_defects.defective_pairs(items.limit(0), asked.limit(0), profiles).count() == 0


# --- 5: scans


def _book():
    body = "the quick modern printer records every careful measure of the modern library while the printer explains each library record".split()
    pages = []
    for no in range(1, 5):
        lines = [f"A Book About Printing   {no + 20}", ""]
        for i in range(6):
            lines.append(" ".join(body[(no * 3 + i * 5 + j) % len(body)] for j in range(6)))
        lines[4] = "the modern library and the lib-"
        lines[5] = "rary of the modcrn printer" if no == 2 else "rary of the modern printer"
        lines[6] = "with some well-"
        lines[7] = "known records."
        lines += [" ".join(body[(no * 7 + i * 3 + j * j) % len(body)] for j in range(6)) + "." for i in range(4)]
        pages.append(("s", no, "\n".join(lines)))
    clean = " ".join(body * 5) + " well-known" * 5 + " known with some records and of" * 5
    parsed = [("s", "x", None, True, "\n\n".join(p[2] for p in pages)), ("c", "x", None, False, clean), ("n", "x", None, None, "null scanned")]
    return [*pages, ("c", 1, clean), ("s", 9, None), ("lost", 1, "A\n12")], parsed


def test_noisy_lines_of_a_book(spark):
    pages, parsed = _book()
    got = {tuple(r) for r in scan_repair.noisy_lines(spark.createDataFrame(pages, PAGES), spark.createDataFrame(parsed, PARSED)).collect()}
    want = {("s", n, 0, "running") for n in range(1, 5)} | {("s", n, 4, "hyphen") for n in range(1, 5)} | {("s", 2, 5, "misread")}
    assert got == want


def test_repaired_book(spark):
    pages, parsed = _book()
    text = scan_repair.repaired_documents(spark.createDataFrame(pages, PAGES), spark.createDataFrame(parsed, PARSED)).collect()
    assert len(text) == 1 and "Printing" not in text[0].text and "lib-" not in text[0].text and "modcrn" not in text[0].text
    assert text[0].text.count("the library of the modern printer") == 4 and text[0].text.count("some well-known records.") == 4


def _printed(rng, paragraphs, head_lines, per_page=14, width=44):
    """Pages as a scanner sees a text: headers, numbers, words broken over lines and pages, and misread words."""
    lines = []
    for p in paragraphs:
        left, line = p.split(" "), ""
        while left:
            w = left.pop(0)
            if not line:
                line = w
            elif len(line) + 1 + len(w) <= width:
                line += " " + w
            elif len(w) >= 8 and "-" not in w and len(line) + 6 <= width + 4 and w.isalpha():
                lines.append(f"{line} {w[:4]}-")
                line = w[4:]
            else:
                lines.append(line)
                line = w
        lines += [line, ""]
    pages, at = [], 0
    while at < len(lines):
        body = lines[at : at + per_page]
        at += per_page
        while body and not body[-1]:
            body.pop()
        body = [l.replace("measure", "mcasure") if rng.random() < 0.5 else l for l in body]
        pages.append("\n".join([*head_lines, "", *body, "", f"- {len(pages) + 5} -"]))
    return pages


def test_planted_pages_come_out_as_they_were_printed(spark):
    rng = random.Random(9)
    words = "careful printer explains measure through quiet libraries recording shelves everywhere although between standard machines another reading paper morning evening glasshouse".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))).capitalize() + "."
    paragraphs = [" ".join(sentence() for _ in range(rng.randrange(3, 7))) for _ in range(24)]
    # a header of five lines, deeper than any fixed number of edge lines
    head = ["HANDBOOK OF PRINTING", "volume the second", "by a Society of Printers", "published at the old press", "third and improved printing"]
    pages = [("s", i + 1, t) for i, t in enumerate(_printed(rng, paragraphs, head))]
    clean = " ".join(sentence() for _ in range(300))
    parsed = [("s", "x", None, True, "\n\n".join(p[2] for p in pages)), ("c", "x", None, False, clean)]
    frames = spark.createDataFrame(pages, PAGES), spark.createDataFrame(parsed, PARSED)
    found = defaultdict(set)
    for r in scan_repair.noisy_lines(*frames).collect():
        found[r.noise].add((r.page_no, r.line_no))
    assert found["running"] == {(p[1], i) for p in pages for i in range(5)}
    assert found["page_number"] == {(p[1], p[2].count("\n")) for p in pages}
    assert found["misread"] == {(p[1], i) for p in pages for i, l in enumerate(p[2].split("\n")) if "mcasure" in l.lower()}
    text = scan_repair.repaired_documents(*frames).first().text
    assert text.split("\n\n") == paragraphs


def test_vocabulary_filter_knows_its_words(spark):
    words = [f"word{i}" for i in range(3000)] + ["größe", "𝑞"]
    known = scan_repair.word_filter(spark.createDataFrame([(w,) for w in words], "word string"))
    assert all(w in known for w in words) and sum(f"other{i}" in known for i in range(2000)) < 100


def test_scans_of_nothing(spark):
    assert scan_repair.noisy_lines(spark.createDataFrame([], PAGES), spark.createDataFrame([], PARSED)).count() == 0


def test_misreadings_reach_the_printed_word():
    assert "modern" in dict(scan_repair.misreadings("modcrn")) and dict(scan_repair.misreadings("rnention"))["mention"] == 1


# --- 6: packing


def test_packing_bounds_and_waste(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 900), rng.randrange(0, 300)) for i in range(3000)] + [(9001, 2500, 10), (9002, 0, 0), (9003, None, 1), (5, 100, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, loss bigint")
    placed = packing.pack_items(df, 1000, loss_col="loss", max_segments=9, max_loss=400).cache()
    boxes = placed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    assert max(b.t for b in boxes) <= 1000 and max(b.n for b in boxes) <= 9
    assert placed.agg(F.sum("tokens")).first()[0] == sum(r[1] or 0 for r in rows)
    assert {r.doc_id for r in placed.filter("pieces > 1").collect()} == {9001}
    tight = packing.container_report(packing.pack_items(df, 1000), 1000).first()
    assert tight.unused < 0.03 and tight.most_segments > 9  # no limit on segments unless one is given
    told = placed.groupBy("container").agg(F.sum("loss").alias("l"), F.sum("segments").alias("s")).agg(F.max("l").alias("l"), F.max("s").alias("s")).first()
    assert told.l <= 400 and told.s <= 9
    assert packing.pack_items(df.limit(0), 1000).count() == 0


def test_items_over_any_limit_are_cut(spark):
    rows = [(1, 500, 450, 1), (2, 100, 10, 20), (3, 1060, 1000, 1), (4, 800, 400, 3), (5, 50, 50, 1), (6, 512, 384, 8), (7, 10, 900, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, loss bigint, segments bigint")
    placed = packing.pack_items(df, 512, loss_col="loss", segments_col="segments", max_segments=8, max_loss=384).collect()
    given = {r[0]: r[1:] for r in rows}
    pieces, loss, segments = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in placed:
        tokens, bears, parts = given[r.doc_id]
        pieces[r.doc_id].append((r.piece_no, r.start_token, r.tokens, r.pieces))
        loss[r.container] += max(0, r.start_token + r.tokens - max(r.start_token, tokens - min(bears, tokens)))
        segments[r.container] += parts * r.tokens / tokens if parts > 8 else parts
    assert {k: len(v) for k, v in pieces.items()} == {1: 2, 2: 3, 3: 3, 4: 2, 5: 1, 6: 1, 7: 1}
    for k, v in pieces.items():
        v.sort()
        assert [x[1] for x in v] == [sum(y[2] for y in v[:i]) for i in range(len(v))] and sum(x[2] for x in v) == given[k][0] and {x[3] for x in v} == {len(v)}
    assert max(loss.values()) <= 384 and max(segments.values()) <= 8


def test_pieces_of_repeated_ids_are_told_apart(spark):
    rows = [(1, 2500), (1, 2500), (1, 1700), (2, 2500), (3, 10)]
    placed = packing.pack_items(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"), 1000).collect()
    items = defaultdict(list)
    for r in placed:
        items[r.doc_id, r.occurrence].append((r.piece_no, r.start_token, r.tokens, r.pieces))
    long = [(0, 0, 1000, 3), (1, 1000, 1000, 3), (2, 2000, 500, 3)]
    want = {(1, 1): [(0, 0, 1000, 2), (1, 1000, 700, 2)], (1, 2): long, (1, 3): long, (2, 1): long, (3, 1): [(0, 0, 10, 1)]}
    assert {k: sorted(v) for k, v in items.items()} == want


def test_equal_items_spread_over_packs(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK", 100)
    monkeypatch.setattr(packing, "EQUAL", 50)
    placed = packing.pack_items(spark.createDataFrame([(1, 30)] * 2000 + [(2, 40)] * 10, "doc_id bigint, tokens bigint"), 100).cache()
    packs = placed.select(F.split("container", "-")[0].alias("p"), "doc_id").filter("doc_id = 1").groupBy("p").count().collect()
    assert len(packs) >= 15 and max(r["count"] for r in packs) < 300
    assert {(r.doc_id, r.occurrence) for r in placed.collect()} == {(1, i) for i in range(1, 2001)} | {(2, i) for i in range(1, 11)}


# --- 7: mixing


def test_mix_meets_shares(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else ["b", "c", None, "untold"][i % 4], rng.randrange(1, 200)) for i in range(6000)] + [(7000 + i, "tiny", 100) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    goals = spark.createDataFrame([("hot", 0.3, 1), ("b", 0.3, 2), ("c", 0.2, 2), ("tiny", 0.15, 2), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, goals)
    got = {r.source: r for r in report.collect()}
    assert set(got) == {"hot", "b", "c", "tiny", "absent"} and {k for k, r in got.items() if r.short} == {"tiny", "absent"} | {k for k in ("hot",) if got["hot"].short}
    repeats = mix.groupBy("doc_id", "source").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("n")).collect()
    assert all(r.n <= got[r.source].max_repeats for r in repeats)
    assert abs(got["b"].mixed_tokens / got["c"].mixed_tokens - 1.5) < 0.05 or got["b"].mixed_tokens == 2 * got["b"].tokens
    small, _ = mixing.mix_sources(docs, goals, budget=50_000)
    by = {r.source: r.t for r in small.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    assert abs(by["hot"] / by["b"] - 1) < 0.03 and abs(sum(by.values()) - 50_000) <= 200
    assert mixing.mix_sources(docs.limit(0), goals)[0].count() == 0


def test_a_tiny_weight_does_not_gather_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE", 300)
    rows = [(i, "large" if i % 2 else "rare", 100) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    goals = spark.createDataFrame([("large", 0.999999, 1), ("rare", 0.000001, 1)], "source string, target_share double, max_repeats int")
    seen = []
    cut = mixing._first_tokens
    monkeypatch.setattr(mixing, "_first_tokens", lambda timed, size: seen.append(timed.count()) or cut(timed, size))
    mix, _ = mixing.mix_sources(docs, goals, budget=500_000)
    by = {r.source: r.n for r in mix.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by == {"large": 5000} and seen[0] < 6000  # later documents were never written
    both, _ = mixing.mix_sources(docs, goals, budget=1_500_000)
    by = {r.source: r.n for r in both.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert by == {"large": 10_000, "rare": 5000}


def test_a_source_that_may_not_repeat_is_not_used(spark):
    docs = spark.createDataFrame([(i, "abc"[i % 3], 100) for i in range(300)], "doc_id bigint, source string, tokens bigint")
    goals = spark.createDataFrame([("a", 2.0, 0), ("b", 2.0, None), ("c", 1.0, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, goals)
    assert {(r.source, r.mixed_tokens, r.most_repeats) for r in report.collect()} == {("a", 0, 0), ("b", 0, 0), ("c", 30_000, 3)}
    assert {r.source for r in mix.collect()} == {"c"}


def test_mix_matches_a_queue_in_memory(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 20)
    monkeypatch.setattr(mixing, "EDGE", 40)
    rng = random.Random(6)
    rows = [(i, rng.choice("aaabbc"), rng.randrange(1, 300)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    goals = {"a": (0.2, 1), "b": (0.5, 3), "c": (0.3, 4)}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(mixing.SEED)), 1).alias("h")).collect()}
    finish = []
    for source, (weight, repeats) in goals.items():
        own = sorted((order[i], i, t) for i, s, t in rows if s == source)
        at = 0
        for rep in range(repeats):
            for _, i, t in own:
                at += t
                finish.append((at / weight, source, i, rep, t))
    for size in (1000, 50_000, 120_000, 10**9):
        want, sofar = set(), 0
        for f in sorted(finish):
            if sofar >= size:
                break
            want.add(f[1:4])
            sofar += f[4]
        mix, _ = mixing.mix_sources(docs, spark.createDataFrame([(k, *v) for k, v in goals.items()], "source string, target_share double, max_repeats int"), budget=size)
        assert {(r.source, r.doc_id, r.repeat) for r in mix.collect()} == want


# --- 8: languages


def test_languages_of_documents(spark, profiles):
    en, de = languages._SEED["en"], languages._SEED["de"]
    rows = [(1, en, "en_GB"), (2, en, None), (3, de, "EN "), (4, en + " " + en + "\n\n" + de, "en"), (5, "", None), (6, None, "en"), (7, "12 34", "??"), (8, de, "deu"), (2, en, None), (9, en + ' "' + de[:60] + '"', "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, lang string, confidence double")
    got = sorted((r.doc_id, r.found_lang) for r in languages.mislabelled(languages.detect_languages(docs, profiles)).collect())
    assert got == [(2, "en"), (2, "en"), (3, "de"), (4, "de"), (4, "en")]
    passages = languages.language_passages(docs, profiles).orderBy("doc_id", "passage_no").collect()
    four = [r for r in passages if r.doc_id == 4]
    assert [r.found_lang for r in four] == ["en", "de"] and four[0].char_start == 0 and four[0].char_end == four[1].char_start and four[1].char_end == len(rows[3][1])
    assert languages.detect_languages(docs.limit(0), profiles).count() == 0
    trained = languages.train_profiles(docs)
    assert set(trained.languages) == set(languages.LANGUAGES)


def test_a_language_without_prototype_has_none(spark):
    en = languages._SEED["en"]
    samples = {k: [v] * 3 for k, v in languages._SEED.items()}  # every trigram seen again: the coverage is whole
    known = hyperlang.train(samples)
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    docs = spark.createDataFrame([(1, polish, "en"), (2, en, "pl"), (3, finnish, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: (r.found_lang, r.confidence) for r in languages.detect_languages(docs, known).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == "en"
    assert {r.found_lang for r in languages.language_passages(docs.filter("doc_id <> 2"), known).collect()} == {"und"}


def test_long_text_is_scored_in_blocks(profiles, monkeypatch):
    text = [languages._SEED["fr"] * 200]
    whole = languages.Analysis(text, profiles).resolve()
    monkeypatch.setattr(languages, "BLOCK", 1000)
    parts = languages.Analysis(text, profiles).resolve()
    assert np.allclose(whole[3], parts[3]) and (whole[0] == parts[0]).all()


def test_schema_types(spark):
    assert isinstance(spark.createDataFrame([], PAGES).schema["page_no"].dataType, T.IntegerType)
