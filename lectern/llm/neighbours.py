"""The k most similar vectors of every vector (problem 2).

Inverted lists with an adaptive scan of dimensions.  Vectors are rotated at random, so that every block of coordinates
holds a fair share of a distance; lists keep them in column blocks.  A list is scanned block by block: after each, the
hypothesis that a candidate still belongs to the k nearest is tested on its partial distance, and candidates that fail
are abandoned.  What survives all blocks is ranked by its cosine, which is summed in doubles over vectors held in half precision
and compared in single precision.

The lists are the leaves of a tree of centroids that is grown until a leaf holds about CELL vectors, so their number follows
the collection.  A vector asks in the list of its nearest centroid and can be found in every list whose centroid is nearly as
near (at most COPIES, none further than MARGIN behind the best): what would be a probe of several lists by the asker is a copy in
several lists of the found, which needs neither a second pass nor a merge.  A list that stays too large for one task (a cluster that
no centroid parts) is asked by groups of its vectors, each a task of its own.  Vectors that are equal are searched once, as a
class, and its members share the result; of a class only its k + 1 smallest ids travel.

Approximate: the tree is fitted on a sample of 1 in SAMPLE_ONE_IN vectors (at least SAMPLE_LEAST, and no more than 64 for each list
to be parted in one fit), every vector is indexed; recall against the exact lists is measured in the tests, and on the large tables in the README.

Results for odd input: vectors that are null, of another length, all zero, or hold a null, NaN or infinite value have no
neighbours and are nobody's neighbour; rows delivered twice count once, and of an id with several vectors the one with the smallest
fingerprint counts; ties of that cosine go to the smaller id; an empty table, or
one with a single usable vector, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import join_side, materialize

BLOCK = 16
EPSILON = 2.1
SPARSE = 0.03
#: Vectors that a list should hold; one with more than twice as many is parted again.
CELL = 2048
#: Lists in which a vector can be found, and how far their centroids' cosines may lie behind the nearest one's.
COPIES, MARGIN = 6, 0.3
#: Children of a node of the tree, and its depth: lists for 4e9 times CELL vectors.
FAN, LEVELS = 256, 4
SAMPLE_ONE_IN, SAMPLE_LEAST, SAMPLE_PER_LIST = 32, 30_000, 64
#: Tasks that scan lists at once, at most.
TASKS = 20_000
SEED = 7
#: What half precision may move a cosine by, with room to spare.
SLACK = 5e-4


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id, v`` of the rows with a usable vector, as delivered."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) == dim)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & sound).filter(finite & some).select(F.col(id_col).alias("id"), v.alias("v"))


def _fingerprint(column: str):
    """Two hashes that stand for a value where equal ones are brought together; the values themselves stay put."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(SEED), column).alias("b"))


def vector_classes(vectors: DataFrame, k: int, id_col: str, vector_col: str, dim: int) -> tuple[DataFrame, DataFrame, int]:
    """Classes of equal vectors, ``low, rest, big, v``: the smallest id, the next k ones (null where there are none) and whether the
    class has more; the members beyond, ``id, low``; and the number of classes.

    Hashes of ids and vectors are shuffled, and the ids of classes with several rows; no vector of a class with one row is."""
    rows = usable_vectors(vectors, id_col, vector_col, dim).withColumn("key", _fingerprint("id")).withColumn("print", _fingerprint("v"))
    seen = materialize(rows.groupBy("key").agg(F.min("print").alias("print"), F.max("print").alias("high"), F.count("*").alias("n")))
    shared = materialize(seen.groupBy("print").agg(F.count("*").alias("ids"), F.sum("n").alias("rows")))
    several = join_side(shared.filter("rows > 1").select("print", "ids"))
    disputed = join_side(seen.filter("print != high").select("key", F.col("print").alias("mine")))
    rows = rows.join(disputed, "key", "left").filter(F.col("mine").isNull() | (F.col("mine") == F.col("print"))).select("id", "print", "v")
    id_type = vectors.schema[id_col].dataType.simpleString()
    none = F.lit(None).cast(f"array<{id_type}>")
    alone = rows.join(several, "print", "left_anti").select(F.col("id").alias("low"), none.alias("rest"), F.lit(False).alias("big"), "v")
    members = materialize(rows.join(several, "print").groupBy("print", "id").agg(F.max("ids").alias("ids")))
    by_print = Window.partitionBy("print").orderBy("id")
    heads = members.withColumn("nth", F.row_number().over(by_print)).filter(F.col("nth") <= k + 1)
    heads = heads.groupBy("print").agg(F.array_sort(F.collect_list("id")).alias("heads"), (F.max("ids") > k + 1).alias("big"))
    heads = join_side(heads, 20_000)
    first = rows.join(several, "print", "left_semi").select("print", "v").dropDuplicates(["print"])
    low, rest = F.element_at("heads", 1), F.slice("heads", 2, k)
    together = first.join(heads, "print").select(low.alias("low"), F.when(F.size("heads") > 1, rest).alias("rest"), "big", "v")
    beyond = members.filter(F.col("ids") > k + 1).join(heads.filter("big"), "print").filter(F.col("id") > F.element_at("heads", -1))
    return alone.unionByName(together), beyond.select("id", low.alias("low")), shared.count()


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _unit(rows) -> np.ndarray:
    m = np.array(list(rows), dtype=np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; empty lists are reseeded."""
    lists = max(1, min(lists, len(sample)))
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        none = np.bincount(at, minlength=lists) == 0
        if none.any():
            sums[none] = sample[rng.choice(len(sample), int(none.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def adaptive_scan(base: np.ndarray, base_ids: np.ndarray, query: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int, tie: np.ndarray | None = None):
    """For each query its k best rows of ``base`` with a cosine of at least ``bound``: arrays (query index, id, cosine),
    ordered by query, falling cosine in single precision and rising ``tie``, by default the id.  A query's own id is left out."""
    tie = base_ids if tie is None else tie
    dim = base.shape[1]
    turn = _rotation(dim)
    rb, rq = (base @ turn).astype(np.float32), (query @ turn).astype(np.float32)
    columns = [np.ascontiguousarray(rb[:, i : i + BLOCK]) for i in range(0, dim, BLOCK)]
    lengths = [(c * c).sum(axis=1) for c in columns]
    limit = lambda d: np.float32(min(1.0, d / dim) * (1 + (EPSILON / np.sqrt(d) if d < dim else 0.0)) ** 2)
    outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(16, 1_000_000 // max(1, len(base)))
    for at in range(0, len(query), step):
        q, ids = rq[at : at + step], query_ids[at : at + step]
        tau = np.maximum(2 - 2 * bound[at : at + step], 0).astype(np.float32) + np.float32(1e-4)

        def block_distances(n: int) -> np.ndarray:
            part = q[:, n * BLOCK : (n + 1) * BLOCK]
            out = part @ (-2 * columns[n].T)
            out += (part * part).sum(axis=1)[:, None]
            out += lengths[n]
            return out

        n, last = 1, len(columns)
        partial = block_distances(0)
        open_ = np.flatnonzero(~np.isfinite(tau))
        if len(open_):  # no bound yet: the k-th distance among the candidates that look best so far
            look = min(3 * k + 1, len(base))
            while n < (last + 1) // 2 and look < len(base):
                partial += block_distances(n)
                n += 1
            near = np.argpartition(partial[open_], look - 1, axis=1)[:, :look]
            full = 2 - 2 * np.matmul(rb[near], q[open_][:, :, None])[:, :, 0]
            full[base_ids[near] == ids[open_][:, None]] = np.inf
            if look > k:
                tau[open_] = np.partition(full, k - 1, axis=1)[:, k - 1] + np.float32(1e-4)
        alive = partial <= (tau * limit(min(n * BLOCK, dim)))[:, None]
        # while many candidates live, whole column blocks are added; then only those of the living
        while n < last and np.count_nonzero(alive) > SPARSE * alive.size:
            partial += block_distances(n)
            n += 1
            alive &= partial <= (tau * limit(min(n * BLOCK, dim)))[:, None]
        qi, bi = np.nonzero(alive)
        d2 = partial[qi, bi]
        while n < last:
            diff = q[qi, n * BLOCK : (n + 1) * BLOCK] - columns[n][bi]
            d2 += np.einsum("ij,ij->i", diff, diff)
            n += 1
            keep = d2 <= tau[qi] * limit(min(n * BLOCK, dim))
            qi, bi, d2 = qi[keep], bi[keep], d2[keep]
        other = base_ids[bi] != ids[qi]
        qi, bi = qi[other], bi[other]
        cosine = np.einsum("ij,ij->i", query[at + qi], base[bi])
        good = cosine >= bound[at + qi] - 1e-6
        qi, bi, cosine = qi[good] + at, bi[good], np.clip(cosine[good], -1.0, 1.0).astype(np.float32)
        order = np.lexsort((tie[bi], -cosine, qi))
        qi, bi, cosine = qi[order], bi[order], cosine[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
        top = place < k
        outs.append((qi[top], base_ids[bi[top]], cosine[top]))
    return tuple(np.concatenate([o[i] for o in outs]) if outs else np.array([]) for i in range(3))


def _pack(m: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(m.astype(np.float16))]


def _unpack(column) -> np.ndarray:
    """Rows of half-precision components as unit vectors in doubles."""
    m = np.frombuffer(b"".join(column), dtype=np.float16).reshape(len(column), -1).astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


@dataclass
class Tree:
    """Centroids by node: ``fans[n]`` are those of node n's children, ``children[n]`` their numbers; a node without a fan is a list."""

    fans: dict[int, np.ndarray] = field(default_factory=dict)
    children: dict[int, np.ndarray] = field(default_factory=dict)
    #: Groups that ask in a list, one where it is not named.
    groups: dict[int, int] = field(default_factory=dict)
    size: int = 1

    def part(self, node: int, centroids: np.ndarray) -> None:
        self.fans[node] = centroids.astype(np.float32)
        self.children[node] = np.arange(self.size, self.size + len(centroids))
        self.size += len(centroids)

    def route(self, u: np.ndarray, copies: int = COPIES, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, place) with place 0 for a row's nearest list, ordered by row and place."""
        rows, lists, sims = [], [], []

        def visit(node: int, at: np.ndarray, sim: np.ndarray) -> None:
            if node not in self.fans:
                rows.append(at)
                lists.append(np.full(len(at), node))
                sims.append(sim)
                return
            s = u[at] @ self.fans[node].T
            near = s >= s.max(axis=1, keepdims=True) - margin
            if s.shape[1] > copies:
                near &= s >= np.partition(s, -copies, axis=1)[:, -copies][:, None]
            for c, child in enumerate(self.children[node].tolist()):
                here = np.flatnonzero(near[:, c])
                if len(here):
                    visit(child, at[here], s[here, c])

        visit(0, np.arange(len(u)), np.zeros(len(u), dtype=np.float32))
        row, leaf, sim = np.concatenate(rows), np.concatenate(lists), np.concatenate(sims)
        order = np.lexsort((leaf, -sim, row))
        row, leaf, sim = row[order], leaf[order], sim[order]
        first = np.searchsorted(row, row, side="left")
        place = np.arange(len(row)) - first
        keep = (place < copies) & (sim >= sim[first] - margin)
        return row[keep], leaf[keep], place[keep]


def grow_tree(sample: DataFrame, total: int, cell: int | None = None) -> Tree:
    """Parts lists until each holds about ``cell`` of the ``total`` vectors, level by level, judged by a materialized sample ``u``.

    Each list to be parted is fitted by one task on a bounded share of its sample; the driver gets centroids and counts by list only."""
    spark, tree, cell = sample.sparkSession, Tree(), cell or CELL
    drawn = sample.count()
    scale = total / max(drawn, 1)
    counts = {0: drawn}
    for _ in range(LEVELS):
        wanted = {n: min(FAN, -(-int(c * scale) // cell)) for n, c in counts.items() if c * scale > 2 * cell}
        wanted = {n: min(w, counts[n] // 8) for n, w in wanted.items() if counts[n] >= 16}
        if not wanted:
            break
        share = {n: SAMPLE_PER_LIST * w / counts[n] for n, w in wanted.items()}
        shared = spark.sparkContext.broadcast((tree, wanted, share))

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, wanted, share = shared.value
            for b in batches:
                if not len(b):
                    continue
                row, node, _ = tree.route(_unpack(b["u"]).astype(np.float32), 1, 0.0)
                u = b["u"].to_numpy()[row]
                chance = np.array([share.get(n, 0.0) for n in node.tolist()])
                take = (pd.util.hash_array(u, categorize=False) >> np.uint64(11)) / float(1 << 53) < chance
                yield pd.DataFrame({"node": node[take], "u": u[take]})

        def fit(b: pd.DataFrame) -> pd.DataFrame:
            node = int(b["node"].iloc[0])
            b = b.sort_values("u")
            fitted = fit_centroids(_unpack(b["u"]), shared.value[1][node])
            return pd.DataFrame({"node": node, "child": np.arange(len(fitted)), "c": [r.tobytes() for r in np.ascontiguousarray(fitted)]})

        picked = sample.mapInPandas(pick, "node bigint, u binary")
        fitted = picked.groupBy("node").applyInPandas(fit, "node bigint, child bigint, c binary").toPandas()
        for node, part in fitted.groupby("node"):
            m = np.frombuffer(b"".join(part.sort_values("child")["c"]), dtype=np.float32).reshape(len(part), -1)
            if len(m) > 1:
                tree.part(int(node), m)
        grown = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({"node": grown.value.route(_unpack(b["u"]).astype(np.float32), 1, 0.0)[1]})

        placed = sample.mapInPandas(place, "node bigint").groupBy("node").agg(F.count("*").alias("n")).toPandas()
        counts = dict(zip(placed["node"].tolist(), placed["n"].tolist()))
    tree.groups = {n: -(-int(c * scale) // (2 * cell)) for n, c in counts.items() if c * scale > 2 * cell}
    return tree


def nearest(vectors: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "vector", dim: int = 64, least: float | None = None) -> DataFrame:
    """``id, neighbour, cosine, place``: the k most similar others of every usable vector, by the operator above.

    ``least`` leaves out what is less similar; every scan starts with it as its bound.  Vectors travel in half precision,
    which moves a cosine by some hundred-thousandths; :func:`close_pairs` decides its bound on the vectors as given."""
    spark = vectors.sparkSession
    classes, beyond, total = vector_classes(vectors, k, id_col, vector_col, dim)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"u": _pack(_unit(b["v"]))})

    share = min(1.0, max(SAMPLE_LEAST, total // SAMPLE_ONE_IN) / max(total, 1))
    tree = grow_tree(materialize(classes.select("v").sample(share, SEED).mapInPandas(pack, "u binary")), total)
    shared = spark.sparkContext.broadcast(tree)
    start = -np.inf if least is None else least - SLACK
    tasks = max(1, min(TASKS, (tree.size + sum(tree.groups.values())) // 2))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = shared.value
        for b in batches:
            if not len(b):
                continue
            u = _unit(b["v"])
            row, leaf, place = tree.route(u.astype(np.float32))
            groups = np.array([tree.groups.get(n, 1) for n in leaf.tolist()])
            of = np.repeat(np.arange(len(row)), groups)
            group = np.arange(len(of)) - np.repeat(np.cumsum(groups) - groups, groups)
            row, leaf, place, groups = row[of], leaf[of], place[of], groups[of]
            own = pd.util.hash_array(b["low"].to_numpy(), categorize=False)[row] % groups.astype(np.uint64)
            packed = np.array(_pack(u), dtype=object)
            yield pd.DataFrame(
                {
                    "leaf": leaf, "grp": group, "asks": (place == 0) & (own == group), "low": b["low"].to_numpy()[row], "rest": b["rest"].to_numpy()[row],
                    "big": b["big"].to_numpy()[row], "u": packed[row],
                }
            )

    def scan(b: pd.DataFrame) -> pd.DataFrame:
        asks = np.flatnonzero(b["asks"].to_numpy())
        if not len(asks):
            return pd.DataFrame({"id": [], "low": [], "found": [], "cosines": []}, dtype=object)
        u, low, rest, big = _unpack(b["u"]), b["low"].to_numpy(), b["rest"].to_numpy(), b["big"].to_numpy()
        q, hit, cosine = adaptive_scan(u, np.arange(len(b)), u[asks], asks, np.full(len(asks), start), k, b["low"].rank(method="first").to_numpy())
        cuts = np.searchsorted(q, np.arange(len(asks) + 1))
        hit = hit.astype(np.int64)
        several = np.array([r is not None for r in rest])
        plain = ~several[asks]
        plain[q[several[hit]].astype(np.int64)] = False
        ids, of, found, cosines = [], [], [], []
        for i, at in enumerate(asks.tolist()):
            s, e = cuts[i], cuts[i + 1]
            if plain[i]:
                ids.append(low[at])
                of.append(None)
                found.append(low[hit[s:e]])
                cosines.append(cosine[s:e])
                continue
            own = [low[at], *(rest[at] if several[at] else ())]
            every = [(-1.0, x) for x in own]
            for h, c in zip(hit[s:e].tolist(), cosine[s:e].tolist()):
                every += [(-c, x) for x in (low[h], *(rest[h] if several[h] else ()))]
            every = sorted(every)[: k + 1]
            for x in own:
                mine = [y for y in every if y[1] != x][:k]
                ids.append(x)
                of.append(None)
                found.append([y for _, y in mine])
                cosines.append([-c for c, _ in mine])
            if big[at]:
                ids.append(None)
                of.append(low[at])
                found.append([y for _, y in every[:k]])
                cosines.append([-c for c, _ in every[:k]])
        return pd.DataFrame({"id": ids, "low": of, "found": found, "cosines": cosines})

    sent = f"leaf bigint, grp bigint, asks boolean, low {id_type}, rest array<{id_type}>, big boolean, u binary"
    lists = f"id {id_type}, low {id_type}, found array<{id_type}>, cosines array<float>"
    placed = classes.mapInPandas(spread, sent)
    result = placed.repartition(tasks, "leaf", "grp").groupBy("leaf", "grp").applyInPandas(scan, lists).filter(F.col("id").isNotNull()).select("id", "found", "cosines")
    # members beyond the k + 1 that travel share their class's list, which is made again from the few lists that hold such classes
    beyond = materialize(beyond)
    if not beyond.isEmpty():
        held = placed.filter("big AND asks").select("leaf", "grp").distinct()
        again = placed.join(join_side(held), ["leaf", "grp"], "left_semi").withColumn("asks", F.col("asks") & F.col("big"))
        of_class = again.groupBy("leaf", "grp").applyInPandas(scan, lists).filter(F.col("id").isNull()).select("low", "found", "cosines")
        result = result.unionByName(beyond.join(join_side(of_class), "low").select("id", "found", "cosines"))
    near = result.select("id", F.posexplode(F.arrays_zip(F.col("found").alias("to"), "cosines")).alias("place", "f"))
    near = near.select("id", F.col("f.to").alias("neighbour"), F.col("f.cosines").cast("double").alias("cosine"), (F.col("place") + 1).alias("place"))
    return near if least is None else near.filter(F.col("cosine") >= least - SLACK)


def close_pairs(vectors: DataFrame, k: int, least: float = 0.9, id_col: str = "chunk_id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """``chunk_a, chunk_b``: pairs of which one is among the k nearest of the other and the cosine is at least ``least``,
    each once, smaller id first.  The cosine that decides is of the vectors as given, in doubles."""
    near = nearest(vectors, k, id_col, vector_col, dim, least)
    pairs = materialize(near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b"), "cosine").distinct())
    sure = pairs.filter(F.col("cosine") >= least + SLACK).select("chunk_a", "chunk_b")
    unsure = pairs.filter((F.col("cosine") < least + SLACK)).select("chunk_a", "chunk_b")
    asked = join_side(unsure.select(F.explode(F.array("chunk_a", "chunk_b")).alias("id")).distinct())
    rows = usable_vectors(vectors, id_col, vector_col, dim).join(asked, "id", "left_semi").withColumn("print", _fingerprint("v"))
    # as in vector_classes, the vector of the smallest print stands for an id
    given = materialize(rows.groupBy("id").agg(F.min(F.struct("print", "v")).alias("s")).select("id", F.transform("s.v", lambda x: x.cast("double")).alias("v")))
    one, two = given.select(F.col("id").alias("chunk_a"), F.col("v").alias("x")), given.select(F.col("id").alias("chunk_b"), F.col("v").alias("y"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    product = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    judged = unsure.join(one, "chunk_a").join(two, "chunk_b").filter(product("x", "y") >= least * F.sqrt(product("x", "x")) * F.sqrt(product("y", "y")))
    return sure.unionByName(judged.select("chunk_a", "chunk_b")).distinct()
