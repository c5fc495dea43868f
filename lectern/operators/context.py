"""From ranked passages to a prompt: near-duplicates, the token budget, order, citations and grounding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, NEAR = 3000, 0.8
_WORD = re.compile(r"[^\W_]+")


def _shingles(text: str, width: int = 3) -> frozenset:
    w = _WORD.findall(text.lower().replace("'", "").replace("’", ""))
    return frozenset(" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def _likeness(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def sandwich(n: int) -> list[int]:
    """Ranks 1..n with the strongest at both ends: 1 3 5 ... 6 4 2."""
    return [*range(1, n + 1, 2), *range(n - n % 2, 0, -2)]


def sandwich_place(rank, total):
    """The place of a rank in the sandwich order, as a column."""
    return F.when(rank % 2 == 1, (rank + 1) / 2).otherwise(total - rank / 2 + 1).cast("int")


def _block(number: int, row) -> str:
    guard = lambda s: re.sub(r"<(/?)(sources)>", r"&lt;\1\2>", s, flags=re.I)
    path = guard(" > ".join(row.section_path if row.section_path is not None else []))
    pages = f"p. {row.page_start}" if row.page_start == row.page_end else f"pp. {row.page_start}-{row.page_end}"
    return f"[{number}] {path + ' ' if path else ''}({pages})\n{guard(row.text)}"


def _tokens(text: str) -> int:
    return -(-(len(text.encode("utf-16-le")) // 2) // 4)


def assemble(candidates: DataFrame, budget: int = BUDGET, near: float = NEAR) -> DataFrame:
    """``qid, chunk_id, rank, fate, place``: near-duplicates of a better passage go, then passages that fit the budget are taken in
    order of rank, smaller ones after one that does not fit; the taken are put in sandwich order and numbered by ``place``.

    A question has a bounded list of candidates (the depth of its retrieval), which is what a task holds."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        kept, fates, used = [], {}, 0
        taken: list = []
        for row in group.itertuples():
            sh = _shingles(row.text)
            if any(_likeness(sh, k) >= near for k in kept):
                fates[row.chunk_id] = "duplicate"
                continue
            kept.append(sh)
            cost = _tokens(_block(len(taken) + 1, row)) + (_tokens("\n\n") if taken else 0)
            if used + cost > budget:
                fates[row.chunk_id] = "over-budget"
                continue
            used += cost
            taken.append(row)
        while taken and _tokens("\n\n".join(_block(i + 1, taken[r - 1]) for i, r in enumerate(sandwich(len(taken))))) > budget:
            fates[taken.pop().chunk_id] = "over-budget"
        place = {taken[r - 1].chunk_id: i + 1 for i, r in enumerate(sandwich(len(taken)))}
        rows = [(row.qid, row.chunk_id, row.rank, fates.get(row.chunk_id, "used"), place.get(row.chunk_id)) for row in group.itertuples()]
        return pd.DataFrame(rows, columns=["qid", "chunk_id", "rank", "fate", "place"]).astype({"place": "Int32"})

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("qid", "chunk_id")}
    columns = ["qid", "chunk_id", "rank", "text", "section_path", "page_start", "page_end"]
    return candidates.select(*columns).groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, rank int, fate string, place int")


def prompts(assembled: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, sources, citations`` of the passages used, in their places."""
    from ..functions.text import source_block

    used = assembled.filter("fate = 'used'").join(chunks.dropDuplicates(["chunk_id"]), "chunk_id")
    block = source_block(F.col("place"), F.col("section_path"), F.col("page_start"), F.col("page_end"), F.col("text"))
    row = F.struct("place", block.alias("block"), "chunk_id", "doc_id", "page_start", "page_end")
    gathered = used.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return gathered.select("qid", F.array_join(F.transform("r", lambda x: x["block"]), "\n\n").alias("sources"), F.transform("r", lambda x: x["chunk_id"]).alias("citations"))


def ground(answers: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Adds the refusal decided before an answer (``no-sources``, ``low-score``) and the citations that name no source;
    answers carry ``text, sources INT, best_score``."""
    from ..functions.text import cited_numbers

    refusal = F.when(F.col("sources") == 0, "no-sources").when((F.lit(min_score) > 0) & (F.col("best_score") < min_score), "low-score")
    unknown = F.filter(cited_numbers(F.col("text")), lambda n: (n < 1) | (n > F.col("sources")))
    return answers.withColumn("decision", refusal).withColumn("unknown_citations", unknown)


def diversify(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over each question's bounded candidates ``qid, chunk_id, rank, score, vector``: ``qid, chunk_id,
    score, rank``.  Relevance is the score scaled to 0..1; ties go to the better rank."""
    import numpy as np

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        s = group["score"].to_numpy(dtype=float)
        rel = np.ones(len(s)) if s.max() == s.min() else (s - s.min()) / (s.max() - s.min())
        v = np.array([np.asarray(x, dtype=float) for x in group["vector"]])
        n = np.linalg.norm(v, axis=1)
        v = v / np.where(n > 0, n, 1)[:, None]
        sims = np.maximum(v @ v.T, 0)
        picked = mmr_order(rel, sims, k, balance)
        return pd.DataFrame({"qid": group["qid"].iloc[picked].to_numpy(), "chunk_id": group["chunk_id"].iloc[picked].to_numpy(), "score": s[picked], "rank": range(1, len(picked) + 1)})

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("qid", "chunk_id")}
    return candidates.select("qid", "chunk_id", "rank", "score", "vector").groupBy("qid").applyInPandas(run, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double, rank int")


def mmr_order(relevance, sims, k: int, balance: float = 0.5) -> list[int]:
    left, picked = list(range(len(relevance))), []
    while left and len(picked) < k:
        gain = lambda i: balance * relevance[i] - (1 - balance) * max((sims[i][j] for j in picked), default=0.0)
        best = left[0]
        for i in left[1:]:
            if gain(i) > gain(best) + 1e-12:
                best = i
        picked.append(best)
        left.remove(best)
    return picked
