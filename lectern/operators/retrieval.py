"""Keyword, dense and hybrid retrieval over batches of queries.

Hits are ``qid, chunk_id, score, rank, retriever``; scores are rounded to ``DIGITS`` before they are ranked, so that the
order does not hang on the order of a sum, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.cluster import join_side, materialize

DIGITS = 6
K1, B = 1.2, 0.75
RRF_K = 60
DRIVER_QUERIES = 10_000
#: Sets of query terms that are scored by one product.
QUERY_BLOCK = 512
#: Scores that one matrix product holds in memory.
PRODUCT_CELLS = 4_000_000
HYBRID_DEPTH, MULTI_QUERY_DEPTH = 50, 20


def top_k(scored: DataFrame, k: int, retriever: str, id_col: str = "chunk_id") -> DataFrame:
    """The k best of each query, ranked from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id_col)
    ranked = scored.withColumn("score", F.round("score", DIGITS) + F.lit(0.0)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("qid", id_col, "score", "rank", F.lit(retriever).alias("retriever"))


# --- keyword search


def indexed_texts(chunks: DataFrame) -> DataFrame:
    """``chunk_id, t`` with the text to index, ``embed_text`` where given, of every id once (the smallest text of a repeated one).

    Only the texts of ids that are delivered more than once are shuffled."""
    rows = chunks.select("chunk_id", F.coalesce("embed_text", "text").alias("t"))
    again = join_side(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id"))
    several = rows.join(again, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("t").alias("t"))
    return rows.join(again, "chunk_id", "left_anti").unionByName(several)


def postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf``; the text indexed is ``embed_text`` where given.  Repeated ids count once."""
    return X.with_compatible(indexed_texts(chunks), "t").select("chunk_id", F.explode(X.terms(F.col("t"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame, posted: DataFrame) -> DataFrame:
    """``chunk_id, len`` of every chunk, those without terms included."""
    own = posted.groupBy("chunk_id").agg(F.sum("tf").alias("len"))
    return chunks.select("chunk_id").distinct().join(own, "chunk_id", "left").na.fill(0, ["len"])


@dataclass(frozen=True)
class Asked:
    """A query set as terms: the distinct sets of terms, the queries of each, and the terms' numbers."""

    sets: list[tuple[str, ...]]
    queries: DataFrame  # qid, key: the place of its set
    numbers: dict[str, int]


def _asked_terms(queries: DataFrame) -> Asked:
    """The stated query set on the driver, as distinct sets of terms."""
    terms = X.terms(X.compatible(F.col("question")))
    by_query = materialize(queries.select("qid", F.array_sort(F.array_distinct(terms)).alias("terms")).filter(F.size("terms") > 0))
    sets = [tuple(r.terms) for r in by_query.select("terms").distinct().orderBy("terms").collect()]
    places = queries.sparkSession.createDataFrame([(list(s), i) for i, s in enumerate(sets)] or [([], -1)], "terms array<string>, key bigint")
    numbers = {t: i for i, t in enumerate(sorted({t for s in sets for t in s}))}
    return Asked(sets, by_query.join(join_side(places), "terms").select("qid", "key"), numbers)


def _score(chunks: DataFrame, asked: Asked, k: int) -> DataFrame:
    """BM25 hits from materialized rows ``chunk_id, len, numbers, kept``: a chunk's length, the numbers of its asked terms in order, and
    whether it may be a hit.  Counts are of all rows.

    A batch of chunks is a matrix of term weights, a block of query sets one of zeros and ones; their product holds the scores, of
    which a task sends on what may be among the k best of each set."""
    corpus = chunks.agg(F.count("*").alias("n"), F.avg("len").alias("a")).first()
    n, avg_len = float(corpus["n"]), float(corpus["a"] or 1.0) or 1.0
    df = np.zeros(max(1, len(asked.numbers)))
    for r in chunks.select(F.explode(F.array_distinct("numbers")).alias("t")).groupBy("t").count().collect():  # one row for each asked term
        df[r["t"]] = r["count"]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    blocks = []
    for at in range(0, len(asked.sets), QUERY_BLOCK):
        some = asked.sets[at : at + QUERY_BLOCK]
        own = sorted({asked.numbers[t] for s in some for t in s})
        place = {t: i for i, t in enumerate(own)}
        matrix = np.zeros((len(own), len(some)))
        for j, s in enumerate(some):
            matrix[[place[asked.numbers[t]] for t in s], j] = 1.0
        blocks.append((at, np.array(own, dtype=np.int64), matrix))
    shared = chunks.sparkSession.sparkContext.broadcast((idf, blocks))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, blocks = shared.value
        best = _Best(sum(m.shape[1] for _, _, m in blocks), k)
        for b in batches:
            b = b[b["numbers"].map(len) > 0]
            if not len(b):
                continue
            sizes = b["numbers"].map(len).to_numpy()
            row, term = np.repeat(np.arange(len(b)), sizes), np.concatenate(b["numbers"].to_numpy())
            cell, tf = np.unique(row * len(idf) + term, return_counts=True)
            row, term = np.divmod(cell, len(idf))
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * b["len"].to_numpy()[row] / avg_len))
            ids = b["chunk_id"].to_numpy()
            for at, own, matrix in blocks:
                place = np.searchsorted(own, term)
                known = (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == term)
                r, c, w = row[known], place[known], weight[known]
                step = max(1, PRODUCT_CELLS // len(own))
                for start in range(0, len(b), step):
                    stop = min(start + step, len(b))
                    here = slice(np.searchsorted(r, start), np.searchsorted(r, stop))
                    dense = np.zeros((stop - start, len(own)))
                    dense[r[here] - start, c[here]] = w[here]
                    best.add(at, ids[start:stop], np.round(dense @ matrix, DIGITS), 0.0)
        yield from best.rows()

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    scored = chunks.filter("kept").select("chunk_id", "len", "numbers").mapInPandas(run, f"qid bigint, chunk_id {kind}, score double")
    hits = top_k(scored, k, "bm25").withColumnRenamed("qid", "key")
    return hits.join(asked.queries, "key").select("qid", "chunk_id", "score", "rank", "retriever")


class _Best:
    """What may be among the k best of each of some queries, over batches of scores; ties with the last place stay."""

    def __init__(self, queries: int, k: int):
        self.k, self.bar = k, np.full(queries, -np.inf)
        self.held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object), np.zeros(0))

    def add(self, at: int, ids: np.ndarray, scores: np.ndarray, above: float = -np.inf) -> None:
        """``scores`` of ids by queries, from the query at place ``at`` on; only those above ``above`` count."""
        least = self.bar[at : at + scores.shape[1]]
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        i, j = np.nonzero((scores >= least[None, :]) & (scores > above))
        place, who, score = (np.concatenate(p) for p in zip(self.held, (at + j, ids[i], scores[i, j])))
        order = np.lexsort((-score, place))
        place, who, score = place[order], who[order], score[order]
        first, end = np.searchsorted(place, place, side="left"), np.searchsorted(place, place, side="right")
        last = np.minimum(first + self.k, end) - 1
        keep, full = score >= score[last], end - first >= self.k
        self.bar[place[full]] = score[last][full]
        self.held = place[keep], who[keep], score[keep]

    def rows(self, names: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        place, who, score = self.held
        if len(place):
            yield pd.DataFrame({"qid": place if names is None else names[place], "chunk_id": who, "score": score})


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int, keep: Column | None = None) -> DataFrame:
    """BM25 for every query of a stated set; counts and lengths are of all chunks, whatever ``keep`` lets through.

    Texts are read and parted into terms once, and nothing of them is shuffled."""
    asked = _asked_terms(queries)
    shared = chunks.sparkSession.sparkContext.broadcast(asked.numbers)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = shared.value
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "len": [len(t) for t in b["terms"]], "numbers": [[n for t in ts if (n := numbers.get(t)) is not None] for ts in b["terms"]]})

    texts = X.with_compatible(indexed_texts(chunks).withColumn("t", F.coalesce("t", F.lit(""))), "t")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = texts.select("chunk_id", X.terms(F.col("t")).alias("terms")).mapInPandas(look_up, f"chunk_id {kind}, len int, numbers array<int>")
    if keep is None:
        rows = rows.withColumn("kept", F.lit(True))
    else:
        allowed = join_side(chunks.filter(keep).select("chunk_id", F.lit(True).alias("kept")).distinct())
        rows = rows.join(allowed, "chunk_id", "left").na.fill(False, ["kept"])
    return _score(materialize(rows), asked, k)


def search_index(postings_: DataFrame, lengths: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same search over a stored index, ``term, chunk_id, tf`` and ``chunk_id, len``; no text is read."""
    asked = _asked_terms(queries)
    words = postings_.sparkSession.createDataFrame(list(asked.numbers.items()) or [("", -1)], "term string, no int")
    own = postings_.join(join_side(words), "term").groupBy("chunk_id").agg(F.flatten(F.collect_list(F.array_repeat("no", F.col("tf").cast("int")))).alias("numbers"))
    rows = lengths.select("chunk_id", F.col("len").cast("int").alias("len")).join(own, "chunk_id", "left")
    return _score(materialize(rows.withColumn("numbers", F.coalesce("numbers", F.array().cast("array<int>"))).withColumn("kept", F.lit(True))), asked, k)


# --- dense search


def _query_blocks(queries: DataFrame) -> Iterator[pd.DataFrame]:
    """The query set ``qid, qv`` in blocks of at most DRIVER_QUERIES rows, one at least."""
    asked = queries.select("qid", "qv").filter(F.col("qv").isNotNull())
    asks = asked.limit(DRIVER_QUERIES + 1).toPandas()
    if len(asks) > DRIVER_QUERIES:
        yield from (pd.DataFrame(rows, columns=["qid", "qv"]) for rows in batched(asked.toLocalIterator(), DRIVER_QUERIES))
    else:
        yield asks


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, id_col: str = "chunk_id", vector_col: str = "vector",
                 measure: str = "cosine") -> DataFrame:
    """Exact search of a stated query set, ``qid, qv``, against all vectors.

    Queries travel as matrices of at most DRIVER_QUERIES; each batch of vectors is scored by matrix products, and a task sends on
    once what may be among the k best of all its batches.  Each further matrix is one more pass over the vectors.  Queries meet vectors of their own
    length.  The filter runs before anything is scored."""
    base = (vectors if keep is None else vectors.filter(keep)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id {vectors.schema[id_col].dataType.simpleString()}, score double"

    def scan(names: np.ndarray, matrix: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            q_len = np.linalg.norm(matrix, axis=1)
            best = _Best(len(matrix), k)
            for b in batches:
                if not len(b):
                    continue
                v = np.array([np.asarray(x, dtype=np.float64) for x in b["v"]])
                ids, v_len = b["id"].to_numpy(), np.linalg.norm(v, axis=1)
                step = max(1, PRODUCT_CELLS // len(v))
                for at in range(0, len(matrix), step):
                    q = matrix[at : at + step]
                    if measure == "cosine":
                        lengths = v_len[:, None] * q_len[None, at : at + step]
                        scores = np.divide(v @ q.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
                    else:
                        scores = -np.sqrt(np.maximum((v_len**2)[:, None] + (q_len[at : at + step] ** 2)[None, :] - 2 * (v @ q.T), 0))
                    best.add(at, ids, np.round(scores, DIGITS))
            yield from best.rows(names)

        return base.filter(F.size("v") == matrix.shape[1]).mapInPandas(run, schema)

    scans = [
        scan(same["qid"].to_numpy(), np.array([np.asarray(v, dtype=np.float64) for v in same["qv"]]))
        for block in _query_blocks(queries) for _, same in block.groupby(block["qv"].map(len))
    ]
    scored = reduce(DataFrame.unionByName, scans) if scans else vectors.sparkSession.createDataFrame([], schema)
    return top_k(scored, k, "dense" if measure == "cosine" else measure)


def upsert(store: DataFrame, records: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Records replace rows of the same id; the rest stays."""
    return store.join(records.select(key), key, "left_anti").unionByName(records)


def delete(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Unknown ids are ignored."""
    return store.join(ids.select(key), key, "left_anti")


def cluster_search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, list_rows: int = 1000, share: float = 0.35, sample: int = 20_000, seed: int = 42) -> DataFrame:
    """Approximate search by inverted lists: vectors lie in the list of their nearest centroid, a query looks into the lists nearest to
    it, and exact cosines rank what it meets there.  Recall, not exact ids, is the contract.

    The number of lists follows the number of vectors, up to 4096 (beyond four million vectors lists grow); centroids are fitted on at
    most ``sample`` vectors and every vector is indexed.  A query probes the square root of the lists, and at least ``share`` of the
    first 64.  Queries travel in blocks, and in each list a query keeps its k best, so what is shuffled does not grow with a list."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    base = vectors.filter(v.isNotNull() & (F.size(v) > 0)).select(F.col(id_col).alias("id"), v.alias("v"))
    total = base.count()
    lists = int(min(4096, max(1, -(-total // list_rows))))
    rows = base.select("v").sample(min(1.0, 1.2 * sample / max(total, 1)), seed).limit(sample).toPandas()["v"] if total > sample else base.select("v").toPandas()["v"]
    dims = [len(x) for x in rows]
    dim = max(set(dims), key=dims.count) if dims else 0
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    fitted = np.array([np.asarray(x, dtype=np.float64) for x in rows if len(x) == dim]).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    fitted = unit(fitted[np.isfinite(fitted).all(axis=1)])
    lists = max(1, min(lists, len(fitted)))
    c = fitted[rng.choice(len(fitted), lists, replace=False)] if len(fitted) else np.zeros((1, dim))
    for _ in range(8):
        at = (fitted @ c.T).argmax(axis=1) if len(fitted) else np.zeros(0, dtype=np.int64)
        sums = np.zeros_like(c)
        np.add.at(sums, at, fitted)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), c)
    probes = min(lists, max(int(np.ceil(np.sqrt(lists))), int(np.ceil(share * min(lists, 64)))))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id {vectors.schema[id_col].dataType.simpleString()}, score double"
    scans = []
    for block in _query_blocks(queries):
        block = block[block["qv"].map(len) == dim]
        q = unit(np.array([np.asarray(x, dtype=np.float64) for x in block["qv"]]).reshape(-1, dim))
        near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
        askers = {l: np.flatnonzero((near == l).any(axis=1)) for l in np.unique(near).tolist()}
        scans.append(_scan_lists(base.filter(F.size("v") == dim), c, askers, q, block["qid"].to_numpy(), k, schema))
    return top_k(reduce(DataFrame.unionByName, scans), k, "ann")


def _scan_lists(base: DataFrame, c: np.ndarray, askers: dict[int, np.ndarray], q: np.ndarray, names: np.ndarray, k: int, schema: str) -> DataFrame:
    """For each batch of vectors, what may be among the k best of the queries that ask in a vector's list."""
    shared = base.sparkSession.sparkContext.broadcast((c, askers, q, names))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, askers, q, names = shared.value
        for b in batches:
            if not len(b):
                continue
            m = np.array([np.asarray(x, dtype=np.float64) for x in b["v"]])
            own = (unit(m) @ c.T).argmax(axis=1)
            u, ids = unit(m), b["id"].to_numpy()
            place, who, score = [], [], []
            for l in np.unique(own).tolist():
                if l not in askers:
                    continue
                here = np.flatnonzero(own == l)
                s = np.round(u[here] @ q[askers[l]].T, DIGITS)
                least = np.partition(s, len(here) - k, axis=0)[len(here) - k] if len(here) > k else np.full(s.shape[1], -np.inf)
                i, j = np.nonzero(s >= least[None, :])
                place.append(askers[l][j])
                who.append(ids[here[i]])
                score.append(s[i, j])
            if place:
                yield pd.DataFrame({"qid": names[np.concatenate(place)], "chunk_id": np.concatenate(who), "score": np.concatenate(score)})

    return base.mapInPandas(run, schema)


# --- fusion


def rrf(lists: DataFrame, k: int, constant: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hit lists keyed ``qid, retriever``."""
    return top_k(lists.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k, "rrf")


def weighted_fusion(lists: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Scores scaled to 0..1 within each list (all equal: 1), weighted; weights are shared among the lists a query has."""
    within = Window.partitionBy("qid", "retriever")
    low, high = F.min("score").over(within), F.max("score").over(within)
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("retriever"))
    marked = lists.select("qid", "chunk_id", "retriever", scaled.alias("s"), weight.cast("double").alias("w"))
    totals = marked.select("qid", "retriever", "w").distinct().groupBy("qid").agg(F.sum("w").alias("all"))
    sums = marked.groupBy("qid", "chunk_id").agg(F.sum(F.col("s") * F.col("w")).alias("sum"))
    return top_k(sums.join(totals, "qid").select("qid", "chunk_id", (F.col("sum") / F.col("all")).alias("score")), k, "weighted")


def multi_query(variant_hits: DataFrame, k: int, depth: int = MULTI_QUERY_DEPTH) -> DataFrame:
    """Fuses the lists of a query's variants (``qid, variant, chunk_id, score, rank``), each cut at ``max(k, depth)``; the list of a
    query that has a single variant passes as it is."""
    variants = variant_hits.groupBy("qid").agg(F.countDistinct("variant").alias("variants"))
    cut = variant_hits.filter(F.col("rank") <= max(k, depth)).join(variants, "qid")
    fused = rrf(cut.filter("variants > 1").withColumn("retriever", F.col("variant").cast("string")), k)
    alone = cut.filter((F.col("variants") == 1) & (F.col("rank") <= k))
    return fused.unionByName(alone.select("qid", "chunk_id", "score", F.col("rank").cast("int").alias("rank"), F.lit("single").alias("retriever")))


def expand_parents(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Children give way to their parents, each at the place and score of its best child; fails where a hit or its parent is no chunk."""
    own = chunks.select("chunk_id", F.coalesce("parent_id", "chunk_id").alias("parent")).dropDuplicates(["chunk_id"])
    there = own.select(F.col("chunk_id").alias("parent"), F.lit(True).alias("there"))
    found = hits.join(own, "chunk_id", "left").join(there, "parent", "left")
    sure = F.when(F.col("there"), F.col("parent")).otherwise(F.raise_error(F.concat(F.lit("no chunk or parent for "), "chunk_id")).cast("string"))
    best = found.withColumn("parent", sure).groupBy("qid", "parent").agg(F.min(F.struct("rank", "score")).alias("b"))
    order = Window.partitionBy("qid").orderBy("b.rank", "parent")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", F.col("parent").alias("chunk_id"), F.col("b.score").alias("score"), "rank")


def rerank(hits: DataFrame, scores: DataFrame, k: int, all_or_nothing: bool = False) -> DataFrame:
    """Orders hits by ``scores`` (``qid, chunk_id, new_score``), ties by their place before.  With ``all_or_nothing`` a query
    with any score missing keeps its order."""
    joined = hits.join(scores, ["qid", "chunk_id"], "left")
    whole = F.min(F.col("new_score").isNotNull()).over(Window.partitionBy("qid")) if all_or_nothing else F.lit(True)
    joined = joined.withColumn("use", whole)
    key = F.when(F.col("use"), F.col("new_score")).otherwise(-F.col("rank").cast("double"))
    order = Window.partitionBy("qid").orderBy(F.desc(key), "rank")
    out = joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return out.select("qid", "chunk_id", F.when(F.col("use"), F.col("new_score")).otherwise(F.col("score")).alias("score"), F.col("place").alias("rank"))


def fusion_problems(lists: DataFrame) -> DataFrame:
    """Ids that a list holds more than once."""
    return lists.groupBy("qid", "retriever", "chunk_id").agg(F.count("*").alias("times")).filter("times > 1")


def inspection(lists: DataFrame, ranked: DataFrame, included: DataFrame, dropped: DataFrame) -> DataFrame:
    """For each candidate who found it and at which place, its final place, and its fate: used, a reason for dropping, or cut."""
    found = lists.groupBy("qid", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("retriever", "rank"))).alias("found_by"))
    joined = found.join(ranked.select("qid", "chunk_id", F.col("rank").alias("final_rank")), ["qid", "chunk_id"], "left")
    joined = joined.join(included.select("qid", "chunk_id", F.lit(True).alias("used")), ["qid", "chunk_id"], "left").join(dropped.select("qid", "chunk_id", "reason"), ["qid", "chunk_id"], "left")
    return joined.select("qid", "chunk_id", "found_by", "final_rank", F.when(F.col("used"), "used").otherwise(F.coalesce("reason", F.lit("cut"))).alias("fate"))
