"""Filling containers of fixed capacity with whole items (problem 6).

Vector bin packing: every item has a size in tokens, a number of segments and a number of loss-bearing tokens, and a
container bounds all three.  A container takes, among the items that fit, the one whose sizes have the largest dot
product with the room left, both as shares of the capacities; large items open containers first.  An item over any of the
three limits is cut, each piece as long as the limits allow, and a piece that leaves room may share its container.

Items are dealt by a hash of id, sizes and occurrence into packs of about PACK items, so that also the items of one id, or of one
size, spread over all packs; each is packed by one task, so no task grows with the input.  A pack leaves at most a container or
two with much room, so the share of unused space does not depend on the number of packs.

Results for odd input: items with a null or zero size are placed nowhere and give no rows; loss-bearing tokens or segments beyond
an item's tokens count as many as the tokens, negative ones as none; repeated ids are separate items of
one document and are told apart by ``occurrence``, from 1 by rising size (equal items are interchangeable); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import materialize

PACK = 20_000
#: Tasks that pack at once, at most; each takes its packs one after the other.
TASKS = 20_000
#: Equal items of one id that are written out by one task.
EQUAL = 10_000
#: Stands for a limit that is not set.
UNLIMITED = 1 << 40


def pack_vectors(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Container number of each row of ``sizes`` (items by dimensions), none above ``capacity`` in any dimension.

    Containers are filled one at a time.  Items of equal sizes are one kind, and a container asks all kinds that still
    fit for their dot product with its room at once."""
    kinds, of = np.unique(sizes, axis=0, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    first = np.searchsorted(of[order], np.arange(len(kinds) + 1))
    left = np.diff(first)
    share = kinds / capacity
    by_size = np.argsort(kinds[:, 0], kind="stable")
    tokens = kinds[by_size, 0]
    out = np.full(len(sizes), -1, dtype=np.int64)
    remaining, box = int(left.sum()), 0
    while remaining:
        room = capacity.astype(np.float64).copy()
        while True:
            # by falling tokens, as the token share leads every dot product; dead kinds are dropped now and then
            hi = bisect_right(tokens, room[0])
            alive = by_size[:hi]
            ok = (left[alive] > 0) & (kinds[alive] <= room).all(axis=1)
            pick = alive[ok]
            if not len(pick):
                break
            k = pick[np.argmax(share[pick] @ (room / capacity))]
            out[order[first[k] + left[k] - 1]] = box
            left[k] -= 1
            remaining -= 1
            room -= kinds[k]
        box += 1
        if box % 64 == 0:
            by_size = by_size[left[by_size] > 0]
            tokens = kinds[by_size, 0]
    return out


def cut_points(tokens: int, loss: int, segments: int, caps: np.ndarray) -> list[int]:
    """Start of each piece of an item, each piece as long as the limits allow.

    The loss-bearing tokens are the item's last ones.  Where segments end is not known: those of an item with more than a
    container takes are dealt in proportion to the tokens."""
    capacity, max_segments, max_loss = (int(c) for c in caps)
    longest = min(capacity, tokens * max_segments // segments) if segments > max_segments else capacity
    starts, at = [], 0
    while at < tokens:
        starts.append(at)
        at = min(at + longest, max(at, tokens - loss) + max_loss)
    return starts


def pack_items(items: DataFrame, capacity: int, id_col: str = "doc_id", tokens_col: str = "tokens", loss_col: str | None = None,
               segments_col: str | None = None, max_segments: int | None = None, max_loss: int | None = None) -> DataFrame:
    """``container, doc_id, occurrence, piece_no, pieces, start_token, tokens, segments, loss``: where each item, or piece of an
    oversized one, goes, and what it takes there of each limit.

    ``loss_col`` defaults to the tokens, ``segments_col`` to one segment an item, ``max_loss`` to the capacity; there is no
    limit on segments unless one is given.  An item's loss-bearing tokens are taken to be its last ones, as an answer follows its
    question.  The segments of a cut item count in each piece, unless they exceed ``max_segments``: then in proportion to its tokens, rounded up."""
    kind = items.schema[id_col].dataType.simpleString()
    sizes_ = ["tokens", "loss", "segments"]
    narrow = items.select(
        F.col(id_col).alias("id"),
        F.col(tokens_col).cast("bigint").alias("tokens"),
        F.col(loss_col or tokens_col).cast("bigint").alias("loss"),
        (F.col(segments_col).cast("bigint") if segments_col else F.lit(1).cast("bigint")).alias("segments"),
    ).filter((F.col("tokens") > 0) & F.col("loss").isNotNull() & F.col("segments").isNotNull())
    # equal items of an id are one row with their number, so an id holds as many rows as it has sizes
    kinds = materialize(narrow.groupBy("id", *sizes_).agg(F.count("*").alias("n")))
    held = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    total = held["n"]
    packs = max(1, -(-total // PACK))
    tasks = min(TASKS, 2 * packs)
    caps = np.array([capacity, max_segments if max_segments is not None else UNLIMITED, max_loss or capacity], dtype=np.int64)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        tokens, loss, segments = (b[c].to_numpy().astype(np.int64) for c in ("tokens", "loss", "segments"))
        loss, segments = np.clip(loss, 0, tokens), np.clip(segments, 0, tokens)
        over = (tokens > caps[0]) | (segments > caps[1]) | (loss > caps[2])
        starts = [cut_points(int(t), int(l), int(g), caps) if o else [0] for t, l, g, o in zip(tokens, loss, segments, over)]
        pieces = np.array([len(x) for x in starts], dtype=np.int64)
        row = np.repeat(np.arange(len(b)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.concatenate([np.array(x, dtype=np.int64) for x in starts])
        end = np.where(piece + 1 < pieces[row], np.append(start[1:], 0), tokens[row])
        size = end - start
        bears = np.maximum(0, end - np.maximum(start, tokens[row] - loss[row]))
        parts = np.where(segments[row] > caps[1], -(-segments[row] * size // tokens[row]), segments[row])
        sizes = np.stack([size, parts, bears], axis=1)
        box = pack_vectors(sizes, caps)
        pack = int(b["pack"].iloc[0])
        return pd.DataFrame(
            {
                "container": [f"{pack}-{x}" for x in box], "id": b["id"].to_numpy()[row], "occurrence": b["occurrence"].to_numpy()[row], "piece_no": piece.astype(np.int32),
                "pieces": pieces[row].astype(np.int32), "start_token": start, "tokens": size, "segments": parts, "loss": bears,
            }
        )

    before = Window.partitionBy("id").orderBy(*sizes_).rowsBetween(Window.unboundedPreceding, -1)
    numbered = kinds.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = numbered.select("id", *sizes_, "n", "earlier", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / EQUAL))).alias("block"))
    spread = blocks.repartition(tasks, F.xxhash64("id", *sizes_, "block")) if held["most"] > EQUAL else blocks
    one = F.sequence(F.col("block") * EQUAL + 1, F.least(F.col("n"), (F.col("block") + 1) * EQUAL))
    dealt = spread.select("id", *sizes_, "earlier", F.explode(one).alias("nth")).select("id", *sizes_, (F.col("earlier") + F.col("nth")).cast("int").alias("occurrence"))
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("id", "tokens", "occurrence"), F.lit(packs)).cast("int")).repartition(tasks, "pack")
    schema = f"container string, id {kind}, occurrence int, piece_no int, pieces int, start_token bigint, tokens bigint, segments bigint, loss bigint"
    return dealt.groupBy("pack").applyInPandas(run, schema).withColumnRenamed("id", id_col)


def container_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items' tokens, the share of their room left unused, and the most that a container holds of each limit."""
    boxes = placed.groupBy("container").agg(F.sum("tokens").alias("used"), F.sum("segments").alias("segments"), F.sum("loss").alias("loss"))
    return boxes.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"),
        (1 - F.sum("used") / (F.count("*") * F.lit(float(capacity)))).alias("unused"), F.max("used").alias("fullest"),
        F.max("segments").alias("most_segments"), F.max("loss").alias("most_loss"),
    )
